"""Per-subject CSV logs: one file per subject, phase and dataset.

Files are named ``<subject>_<phase>_<dataset>.csv``. Schemas are fixed, never inferred, and headers are
checked against them, because column order differs between datasets and Spark binds CSV by position.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialstats.operators.clean import drop_columns, exclude
from trialstats.operators.linking import bind_rows
from trialstats.sources.cells import file_headers, file_rows

SUBJECT = "subjID"
#: Bytes of logs that a task reads, and what opening a file counts for beside its size.
TASK_BYTES, FILE_BYTES = 64 << 20, 64 << 10


def log_schema(ddl: str) -> T.StructType:
    """``"a int, b string"`` as a schema (no session needed)."""
    types = {"int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType()}
    fields = [part.split() for part in ddl.split(",")]
    return T.StructType([T.StructField(name, types[kind]) for name, kind in fields])


def file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def folder_from_file() -> Column:
    """Name of the folder a row's file is in, for logs kept in one folder per participant."""
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)


def subject_from_file() -> Column:
    """Subject id from the file name, for logs that do not carry one."""
    return F.regexp_extract(file_name(), r"^(\d+)_", 1).cast("int")


def phase_from_file() -> Column:
    """Phase from the file name: the part between the subject and the dataset."""
    return F.regexp_extract(file_name(), r"^\d+_([^_]+)_", 1)


def read_glob(
    spark: SparkSession,
    directory: str,
    pattern: str,
    schema: T.StructType,
    header: bool = True,
    recursive: bool = False,
    file_columns: Mapping[str, Column] | None = None,
    mode: str = "FAILFAST",
    names: str | None = None,
) -> DataFrame:
    """All CSV files of a directory whose names match a glob, as one DataFrame.

    Subdirectories are left out unless ``recursive``. ``names`` is a regular expression that a file's whole name must
    match as well. ``file_columns`` adds columns computed from the file's name or path, for logs without a subject id
    or a phase. A cell that doesn't fit its type is an error; blank cells are missing, and ``mode="PERMISSIVE"`` makes
    bad ones missing too.
    """
    reader = spark.read.schema(schema).option("header", header).option("pathGlobFilter", pattern).option("mode", mode)
    reader = reader.option("enforceSchema", not header).option("recursiveFileLookup", recursive)
    df = reader.csv(directory)
    if names is not None:
        df = df.filter(file_name().rlike(f"^(?:{names})$"))
    return df.select("*", *[value.alias(name) for name, value in (file_columns or {}).items()])


def _whole_files(spark: SparkSession, directory: str, pattern: str, names: str | None, recursive: bool) -> DataFrame:
    """Files as they are, dealt over as many tasks as their bytes and number ask for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(directory)
    if names is not None:
        files = files.filter(file_name().rlike(f"^(?:{names})$"))
    count, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()  # from the listing, no file is read
    return files.coalesce(max(1, -(-(size + FILE_BYTES * count) // TASK_BYTES)))


def read_by_name(
    spark: SparkSession,
    directory: str,
    pattern: str,
    schema: T.StructType | None,
    names: str | None = None,
    mode: str = "FAILFAST",
    recursive: bool = False,
    file_columns: Mapping[str, Column] | None = None,
    bad_column: str | None = None,
) -> DataFrame:
    """As ``read_glob`` for files with headers whose columns stand in any order, bound by name, file by file.

    Each file is read whole, being one subject's log, through Spark's readers; its first line names the others' cells. Quoted
    cells may hold line breaks, and a file may have any number of columns. Columns that a file lacks are missing in its rows;
    other columns are not read. A row with more or fewer cells than its header, and a cell that doesn't fit its type, are errors;
    with ``mode="PERMISSIVE"`` a bad cell is missing, and ``bad_column`` has the text of a bad row.

    Without a ``schema``, the columns are all that any file names, in the order of their first place, with the narrowest of
    int, double and string that fits all cells.
    """
    files = _whole_files(spark, directory, pattern, names, recursive)
    columns = schema.names if schema is not None else _named(files)
    extra = {k: v.alias(k) for k, v in (file_columns or {}).items()}
    told = files.select(F.struct(F.lit(0).alias("_"), *extra.values()).alias("file"), "content")
    kind = told.schema["file"].dataType.simpleString()
    rows = told.mapInArrow(file_rows(list(columns)), f"file {kind}, place int, cells array<string>, bad string")
    if mode == "FAILFAST":
        rows = rows.withColumn("cells", F.when(F.col("bad").isNull(), F.col("cells")).otherwise(F.raise_error(F.concat(F.lit("a bad row: "), F.col("bad")))))
    if schema is None:
        schema = _narrowest(rows, columns)

    def typed(place: int, column: T.StructField) -> Column:
        text = F.get("cells", F.lit(place))
        value = text.try_cast(column.dataType)
        if mode == "FAILFAST":
            told = F.concat(F.lit(f"{column.name} holds a bad {column.dataType.simpleString()}: "), text)
            value = F.when(text.isNotNull() & value.isNull(), F.raise_error(told)).otherwise(value)
        return F.when(text.isNotNull(), value).alias(column.name)

    bad = [F.col("bad").alias(bad_column)] if bad_column else []
    return rows.select(*[typed(i, f) for i, f in enumerate(schema.fields)], *[F.col(f"file.{k}") for k in extra], *bad)


def _named(files: DataFrame) -> list[str]:
    """All column names of the files' headers; files of one layout count once."""
    layouts = files.select("content").mapInArrow(file_headers, "names array<string>").distinct()
    places = layouts.select(F.posexplode("names").alias("place", "name")).filter("name <> ''").groupBy("name").agg(F.min("place").alias("place"))
    return [r["name"] for r in places.orderBy("place", "name").collect()]


def _narrowest(rows: DataFrame, columns: Sequence[str]) -> T.StructType:
    """One pass over the cells: for each column, whether all that aren't missing are whole numbers, or numbers."""
    kinds = [T.IntegerType(), T.DoubleType()]
    fits = [[F.count(cell) == F.count(cell.try_cast(k)) for k in kinds] for cell in (F.get("cells", F.lit(i)) for i in range(len(columns)))]
    said = rows.agg(F.count(F.lit(1)), *[f for pair in fits for f in pair]).first()[1:]
    return T.StructType(
        [T.StructField(c, next((k for k, ok in zip(kinds, said[2 * i : 2 * i + 2], strict=True) if ok), T.StringType())) for i, c in enumerate(columns)]
    )


def read_files(
    spark: SparkSession, paths: Sequence[str], schema: T.StructType, header: bool = True, mode: str = "FAILFAST"
) -> DataFrame:
    """An explicit list of CSV files as one DataFrame."""
    reader = spark.read.schema(schema).option("header", header).option("enforceSchema", not header).option("mode", mode)
    return reader.csv(list(paths))


@dataclass(frozen=True)
class Dataset:
    """Where a dataset's logs are, how each phase is laid out, and whom to leave out.

    ``headerless`` names the phases whose files have no header line. ``drop`` lists the columns a plain
    ``load`` removes.
    """

    directory: str
    name: str
    schemas: Mapping[str, T.StructType]
    excluded: Sequence[int] = ()
    drop: Sequence[str] = ()
    headerless: frozenset[str] = field(default_factory=frozenset)

    def load(self, spark: SparkSession, phase: str, drop: bool = True) -> DataFrame:
        """All subjects' files of one phase, without the excluded subjects.

        A phase without a layout takes its columns and their types from its files. ``drop`` leaves out those of the
        dataset's dropped columns that the phase has.
        """
        pattern, schema = f"[0-9]*_{phase}_{self.name}.csv", self.schemas.get(phase)
        # digits directly before the phase; a phase may be a glob of alternatives, {a,b}-c
        exact = re.sub(r"\\\{(.*?)\\\}", lambda m: f"(?:{m[1].replace(',', '|')})", re.escape(phase))
        names = rf"\d+_{exact}_{re.escape(self.name)}\.csv"
        if phase in self.headerless:
            df = read_glob(spark, self.directory, pattern, schema, header=False, names=names)
        else:
            df = read_by_name(spark, self.directory, pattern, schema, names)
        df = exclude(df, SUBJECT, self.excluded)
        gone = self.drop if schema is not None else [c for c in self.drop if c in df.columns]
        return drop_columns(df, gone) if drop else df

    def load_tagged(
        self, spark: SparkSession, phases: Mapping[str, str], tag: str = "time", drop: bool = True
    ) -> DataFrame:
        """Several phases as one DataFrame; ``phases`` maps phase to the tag its rows get."""
        return bind_rows([self.load(spark, phase, drop).withColumn(tag, F.lit(t)) for phase, t in phases.items()])


# Log layouts of the two study designs, and the subjects the second one leaves out.
ITEM_SCHEMAS_1 = {
    "bdi": log_schema("itemID int, value int, subjID int, gender int, age int, quesName string"),
    "rrs": log_schema("cond string, itemID int, value int, subjID int, gender int, age int, quesName string"),
    "stai1": log_schema("cond string, itemID int, value int, subjID int, gender int, age int, quesName string"),
    "stai2": log_schema("cond string, itemID int, value int, subjID int, gender int, age int, quesName string"),
}
TRIAL_SCHEMAS_1 = {
    "cycles": log_schema(
        "subjID int, gender int, age int, phase string, cycleN int, order int, itemID int, "
        "TNTcond string, valence string, cue string, tar string, correct int"
    ),
    "TNT": log_schema(
        "subjID int, gender int, age int, phase string, block string, order int, itemID int, "
        "TNTcond string, valence string, cue string, tar string, intrusion int, RT double"
    ),
    "{pre,post}-recog": log_schema(
        "subjID int, gender int, age int, phase string, order int, itemID int, "
        "TNTcond string, valence string, tar string, correct int, RT double"
    ),
    "{pre,post}-rating": log_schema(
        "subjID int, gender int, age int, phase string, order int, itemID int, "
        "TNTcond string, valence string, cue string, tar string, val int, aro int"
    ),
}
_ENCODING_2 = (
    "IAPS int, TNTcond string, cue string, itemID int, valence string, "
    "subjID int, gender int, age int, CB int, order int"
)
SCHEMAS_2 = {
    "bdi": log_schema("itemID int, value int, subjID int, gender int, age int, CB int"),
    "rrs": log_schema("itemID int, cond string, value int, subjID int, gender int, age int, CB int"),
    "staiS": log_schema("itemID int, cond string, value int, subjID int, gender int, age int, CB int"),
    "staiT": log_schema("itemID int, cond string, value int, subjID int, gender int, age int, CB int"),
    "encoding": log_schema(_ENCODING_2),
    "cycles": log_schema(_ENCODING_2 + ", cycleN int, correct int"),
    "pre-rating": log_schema(_ENCODING_2 + ", val int, aro int, correct int"),
    "post-rating": log_schema(_ENCODING_2 + ", val int, aro int, correct int"),
    "sub-learn": log_schema("IAPS int, valence string, cond string, cue string, sub int, time int, order int"),
}
EXCLUDED_2 = (3, 5, 7, 11, 13, 16, 18, 204, 29, 30, 32, 33, 38, 41, 42)
DROP_1 = ("tar", "valence", "gender", "age")
DROP_2 = ("IAPS", "cue", "valence", "gender", "age", "CB")


def first_design(directory: str, name: str) -> Dataset:
    """Logs of the first study design; its trial phases have no header line."""
    schemas = {**ITEM_SCHEMAS_1, **TRIAL_SCHEMAS_1}
    return Dataset(directory, name, schemas, drop=DROP_1, headerless=frozenset(TRIAL_SCHEMAS_1))


def second_design(directory: str, name: str, schemas: Mapping[str, T.StructType] | None = None) -> Dataset:
    """Logs of the second study design; ``schemas`` adds or replaces phase layouts."""
    return Dataset(directory, name, {**SCHEMAS_2, **(schemas or {})}, EXCLUDED_2, DROP_2)
