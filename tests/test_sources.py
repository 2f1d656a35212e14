"""Per-subject CSV logs: globs, headers, headerless files, ids from names, exports."""

import io

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trialstats.operators.summarise import any_by, count_by
from trialstats.session import shared_dir
from trialstats.sources import logs, tables


def write(folder, name, *lines):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_text("\n".join(lines) + "\n")


ITEMS = "itemID,value,subjID,gender,age,CB"
TRIAL_SCHEMA = logs.log_schema("subjID int, phase string, itemID int, correct int")


@pytest.fixture
def study(tmp_path):
    write(tmp_path, "03_bdi_two.csv", ITEMS, "0,2,03,1,20,1", "1,,03,1,20,1")
    write(tmp_path, "4_bdi_two.csv", ITEMS, "0,1,4,0,21,1")
    write(tmp_path, "5_bdi_two.csv", ITEMS, "0,3,5,0,22,1")
    write(tmp_path, "4_bdi_two18.csv", ITEMS, "0,9,4,0,21,1")
    write(tmp_path / "excluded", "9_bdi_two.csv", ITEMS, "0,7,9,0,22,1")
    return tmp_path


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_scan_takes_one_dataset_and_leaves_out_subfolders_and_excluded_subjects(spark, study):
    data = logs.Dataset(str(study), "two", logs.SCHEMAS_2, excluded=(5,), drop=("gender", "age", "CB"))
    assert rows(data.load(spark, "bdi")) == [(0, 1, 4), (0, 2, 3), (1, None, 3)]
    assert data.load(spark, "bdi", drop=False).columns == ITEMS.split(",")


def test_padded_ids_are_numbers(spark, study):
    data = logs.second_design(str(study), "two")
    got = data.load(spark, "bdi", drop=False).select("subjID").distinct()
    assert rows(got) == [(4,)]  # 3 and 5 are left out by the design


def test_wrong_column_order_fails_loudly(spark, study):
    wrong = logs.log_schema("value int, itemID int, subjID int, gender int, age int, CB int")
    df = logs.read_glob(spark, str(study), "[0-9]*_bdi_two.csv", wrong)
    with pytest.raises(Exception, match="(?i)header"):
        df.collect()


def test_headerless_alternation_with_phase_from_the_column_or_the_file(spark, tmp_path):
    write(tmp_path, "7_pre-recog_one.csv", "7,pre-recog,1,1")
    write(tmp_path, "7_post-recog_one.csv", "7,post-recog,1,0")
    data = logs.Dataset(
        str(tmp_path), "one", {"{pre,post}-recog": TRIAL_SCHEMA}, headerless=frozenset({"{pre,post}-recog"})
    )
    assert rows(data.load(spark, "{pre,post}-recog")) == [(7, "post-recog", 1, 0), (7, "pre-recog", 1, 1)]
    named = logs.read_glob(
        spark,
        str(tmp_path),
        "*_{pre,post}-recog_one.csv",
        TRIAL_SCHEMA,
        header=False,
        file_columns={"phase_of": logs.phase_from_file(), "id_of": logs.subject_from_file()},
    )
    assert rows(named.select("phase_of", "id_of")) == [("post-recog", 7), ("pre-recog", 7)]


def test_phases_tagged_and_bound(spark, tmp_path):
    schema = logs.log_schema("subjID int, val int")
    write(tmp_path, "7_pre-rating_x.csv", "subjID,val", "7,1")
    write(tmp_path, "7_post-rating_x.csv", "subjID,val", "7,")
    data = logs.Dataset(str(tmp_path), "x", {"pre-rating": schema, "post-rating": schema})
    got = data.load_tagged(spark, {"pre-rating": "pre", "post-rating": "post"})
    assert rows(got) == [(7, 1, "pre"), (7, None, "post")]


def test_recursive_scan_and_explicit_files(spark, study):
    schema = logs.SCHEMAS_2["bdi"]
    deep = logs.read_glob(spark, str(study), "*_bdi_two.csv", schema, recursive=True)
    assert rows(deep.select("subjID").distinct()) == [(3,), (4,), (5,), (9,)]
    some = logs.read_files(spark, [f"{study}/4_bdi_two.csv", f"{study}/excluded/9_bdi_two.csv"], schema)
    assert rows(some.select("subjID")) == [(4,), (9,)]


def test_ids_for_logs_without_a_subject_column(spark, tmp_path):
    write(tmp_path, "11_sub-learn_two.csv", "IAPS,valence,cond,cue,sub,time,order", "2224,pos,sub,tent4,2224,0,301")
    got = logs.read_glob(
        spark, str(tmp_path), "*_sub-learn_two.csv", logs.SCHEMAS_2["sub-learn"], file_columns={"subjID": logs.subject_from_file()}
    )
    assert rows(got.select("subjID", "sub")) == [(11, 2224)]


def test_fact_table_round_trip_prunes_partitions(spark, tmp_path):
    df = spark.createDataFrame([(1, "ds", "pre"), (2, "ts", "post")], "subj int, expt string, phase string")
    path = f"{shared_dir(spark)}/facts"
    tables.save_facts(df, path)
    loaded = tables.load_table(spark, path)
    one = loaded.filter(F.col("expt") == "ts")
    assert rows(one.select("subj", "phase")) == [(2, "post")]
    assert "PartitionFilters: [isnotnull(expt" in one._jdf.queryExecution().toString()


def test_facts_are_written_in_few_even_files(spark):
    df = spark.range(0, 4000, numPartitions=16).select(
        F.col("id").alias("subj"), F.when(F.col("id") % 3 == 0, "ds").otherwise("ts").alias("expt")
    )
    path = f"{shared_dir(spark)}/facts"
    tables.save_facts(df, path)
    back = tables.load_table(spark, path)
    assert back.count() == 4000
    assert back.select(F.col("_metadata.file_path").alias("f")).distinct().count() <= 4


def test_intermediate_tables_round_trip(spark):
    path = f"{shared_dir(spark)}/table"
    tables.save_table(spark.createDataFrame([(1, None), (2, 0.5)], "subj int, val double"), path)
    assert rows(tables.load_table(spark, path)) == [(1, None), (2, 0.5)]


def test_participants_by_folder(spark, tmp_path):
    schema = logs.log_schema("subjID int, itemID int, val int")
    write(tmp_path / "24_a", "24_pre-rating_x.csv", "24,1,5", "24,2,")
    write(tmp_path / "24_b", "24_pre-rating_x.csv", "24,1,")
    log = logs.read_glob(
        spark, str(tmp_path), "*_{pre,post}-rating_*.csv", schema, header=False, recursive=True,
        file_columns={"who": logs.folder_from_file()},
    )
    skipped = any_by(log, ["who", "itemID"], F.col("val").isNull(), "skipped")
    assert rows(count_by(skipped, ["who", "skipped"])) == [("24_a", False, 1), ("24_a", True, 1), ("24_b", True, 1)]


def test_wide_export_writes_headers(spark, tmp_path):
    path = f"{shared_dir(spark)}/wide"
    tables.export_csv(spark.createDataFrame([(1, 0.5, None)], "subjID int, diff_aro_b double, bdi int"), path)
    back = spark.read.option("header", True).csv(path)
    assert back.columns == ["subjID", "diff_aro_b", "bdi"]
    assert rows(back) == [("1", "0.5", None)]


def test_columns_bind_by_name_and_file_names_match_whole(spark, study):
    write(study, "6_bdi_two.csv", "CB,value,itemID,subjID,age,gender,note", '1,2,0,6,20,1,"a, b"')
    write(study, "9_old_bdi_two.csv", ITEMS, "0,9,9,0,21,1")
    data = logs.Dataset(str(study), "two", logs.SCHEMAS_2)
    got = data.load(spark, "bdi", drop=False)
    assert rows(got.select("subjID", "itemID", "value", "CB")) == [(3, 0, 2, 1), (3, 1, None, 1), (4, 0, 1, 1), (5, 0, 3, 1), (6, 0, 2, 1)]


def test_a_bad_cell_is_an_error_unless_asked_for(spark, tmp_path):
    write(tmp_path, "7_bdi_two.csv", ITEMS, "0,abc,7,1,20,1")
    with pytest.raises(Exception, match="value holds a bad int: abc"):
        logs.Dataset(str(tmp_path), "two", logs.SCHEMAS_2).load(spark, "bdi").collect()
    schema = logs.SCHEMAS_2["bdi"]
    with pytest.raises(Exception, match="(?i)malformed|bad"):
        logs.read_glob(spark, str(tmp_path), "*.csv", schema).collect()
    got = logs.read_by_name(spark, str(tmp_path), "*.csv", schema, mode="PERMISSIVE")
    assert rows(got.select("value", "subjID")) == [(None, 7)]


def test_quoted_line_breaks_and_many_columns(spark, tmp_path):
    names = [f"c{i}" for i in range(200)]
    write(tmp_path, "1_wide_x.csv", ",".join(["subjID", *names]), ",".join(["1", *map(str, range(200))]))
    write(tmp_path, "2_wide_x.csv", "c199,note,subjID", '7,"two\nlines, a ""quote""",2', "", ' , " kept ",2')
    schema = logs.log_schema("subjID int, c199 int, note string, c0 double")
    got = logs.read_by_name(spark, str(tmp_path), "*.csv", schema, file_columns={"who": logs.subject_from_file()})
    assert rows(got) == [(1, 199, None, 0.0, 1), (2, 7, 'two\nlines, a "quote"', None, 2), (2, None, "kept", None, 2)]


def test_bad_rows(spark, tmp_path):
    write(tmp_path, "1_p_x.csv", "subjID,a", "1,2", "1,2,3", "1")
    schema = logs.log_schema("subjID int, a int")
    with pytest.raises(Exception, match="a bad row: 1,2,3"):
        logs.read_by_name(spark, str(tmp_path), "*.csv", schema).collect()
    got = logs.read_by_name(spark, str(tmp_path), "*.csv", schema, mode="PERMISSIVE", bad_column="bad")
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 2, "1,2,3"), (1, 2, None), (1, None, "1")]


def test_a_phase_without_a_layout_takes_its_files(spark, tmp_path):
    write(tmp_path, "1_TNT_two.csv", "subjID,block,RT,TNTcond,age", "1,0,0.5,t,20", "1,1,,nt,20")
    write(tmp_path, "2_TNT_two.csv", "block,subjID,intrusion,RT", "2,2,1,3")
    write(tmp_path, "3_TNT_two.csv", "block,subjID,intrusion,RT", "9,3,1,3")
    df = logs.second_design(str(tmp_path), "two").load(spark, "TNT")
    assert dict(df.dtypes) == {"subjID": "int", "block": "int", "RT": "double", "TNTcond": "string", "intrusion": "int"}
    assert rows(df.select("subjID", "block", "RT", "intrusion")) == [(1, 0, 0.5, None), (1, 1, None, None), (2, 2, 3.0, 1)]


def test_many_small_files_in_few_tasks(spark, tmp_path):
    for i in range(3000):
        (tmp_path / f"{i}_p_x.csv").write_text(f"subjID,a\n{i},{i % 7}\n")
    df = logs.read_by_name(spark, str(tmp_path), "*_p_x.csv", logs.log_schema("subjID int, a int"))
    assert df.rdd.getNumPartitions() == 3 and df.selectExpr("sum(subjID)", "sum(a)").first()[0] == 3000 * 2999 // 2


def _joined(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_ordered_csv_is_one_file_in_parts(spark, tmp_path, request):
    rows = spark.range(5000).select((F.lit(4999) - F.col("id")).alias("subj"), F.when(F.col("id") % 7 > 0, F.col("id") / 4).alias("a b"))
    rows = rows.withColumn("text", F.when(F.col("subj") == 3, 'say "x",\nthen y').otherwise(F.lit("  z")))
    out = tmp_path / "table.csv"
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tables.export_ordered_csv(rows.repartition(6), str(out), ["subj"], missing="NA")
    back = pd.read_csv(io.StringIO(_joined(out)))
    known = rows.orderBy("subj").toPandas()
    pd.testing.assert_frame_equal(back, known)
    assert len(list(out.glob("part-*"))) > 1
    assert _joined(out).splitlines()[0] == "subj,a b,text"
    tables.export_ordered_csv(rows.limit(0), str(out), ["subj"])
    assert _joined(out) == "subj,a b,text\n"


def test_ordered_csv_that_fails_leaves_what_was_there(spark, tmp_path):
    out = tmp_path / "table.csv"
    tables.export_ordered_csv(spark.range(3), str(out), ["id"])
    bad = spark.range(100).select(F.when(F.col("id") == 77, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="broken"):
        tables.export_ordered_csv(bad, str(out), ["id"])
    assert _joined(out) == "id\n0\n1\n2\n"
    assert [p.name for p in tmp_path.iterdir()] == ["table.csv"]
