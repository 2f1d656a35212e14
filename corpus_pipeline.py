"""A training corpus from raw documents, in five stages. Each takes and returns a table; only the last changes its columns.

Language: documents go whose language can't be told (no letter) or is told with a score below LEAST_SCORE.
Lines: lines that stand in an earlier document, up to one word, go; documents of which nothing but white space is left
go with them, unless they were blank before. Near duplicates: the smallest id of each class stays. Substrings: passages
of 13 words that an earlier document has go; emptied documents go with them. Packing: sequences of at most 1024 ids.

The table has the columns of COLUMNS; ``source`` and ``n_chars`` are missing where it lacks them, and further columns are left behind by
the first stage. Null ids and repeated rows are rows like others, except that near duplicates keep one row of a class, and that
rows of one id don't take each other's passages. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialstats.llm import common, language, lines, minhash, packing, substrings

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5
BROADCAST_BYTES = 32 << 20


def _documents(rows: DataFrame, text: str, changed: Column) -> DataFrame:
    """``carried`` as columns, with the text left; rows go that had words and have none now."""
    words = F.col(text).rlike("[^\\x20\\x09-\\x0D]")
    before = F.col("carried.text").rlike("[^\\x20\\x09-\\x0D]")
    kept = rows.filter(words | ~F.coalesce(before, F.lit(False)))
    new = F.when(changed, F.col(text)).otherwise(F.col("carried.text"))
    size = F.when(changed, F.char_length(F.col(text)).cast("long")).otherwise(F.col("carried.n_chars"))
    return kept.select("carried.doc_id", new.alias("text"), "carried.lang", "carried.source", size.alias("n_chars"))


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1, learnt from the documents' own labels."""
    model = language.train(docs.select("text", "lang"))
    told = language.predict(docs, model, [c for c in COLUMNS if c != "text"], text_back=True)
    kept = told.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select(*[F.col("text" if c == "text" else f"carried.{c}").alias(c) for c in COLUMNS])


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4."""
    return _documents(lines.remove_lines(docs, carry=COLUMNS), "kept", F.col("n_removed") > 0)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6 over numbered rows: one row of each class stays, that with the smallest id; a null id is the largest."""
    rows = common.written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "rows")
    classes = minhash.classes(rows, id_column="row", carry=["doc_id"])
    place = F.struct(F.col("carried.doc_id").isNull().alias("none"), "carried.doc_id", F.col("doc_id").alias("row"))
    classes = common.written(classes.select("class_id", place.alias("place")), "classes")
    firsts = classes.groupBy("class_id").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = classes.join(firsts, "class_id").filter("place.row <> first.row").select("place.row")
    gone = common.written(gone, "gone")
    told = F.broadcast(gone) if 8 * gone.count() <= BROADCAST_BYTES else gone
    return rows.join(told, "row", "left_anti").select(*COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10."""
    return _documents(substrings.remove_repeats(docs, carry=COLUMNS), "kept", F.col("n_removed") > 0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2."""
    return packing.pack(docs).drop("row")


#: Tables that the last stage but the packing wrote for itself. Its result is written before the next stage begins.
_OWN: list[str] = []


def _alone(stage):
    """The stage, once the tables that the stage before wrote for itself are gone: their results have been written."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = set(docs.inputFiles())
        common.discard(spark, [p for p in _OWN if not any(p in name for name in read)])
        _OWN.clear()
        with common.noted() as paths:
            out = stage(spark, docs, sf_dir)
        if stage is not packed:
            _OWN.extend(paths)
        return out

    return run


STAGES = [
    ("language", _alone(by_language)),
    ("lines", _alone(without_repeated_lines)),
    ("near duplicates", _alone(without_near_duplicates)),
    ("substrings", _alone(without_repeated_passages)),
    ("packing", _alone(packed)),
]
#: Neither the trained net nor the tokenizer can be said in SQL; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written and read again."""
    docs = common.documents(spark, sf_dir)
    docs = docs.withColumns({c: F.lit(None).cast(kind) for c, kind in (("source", "string"), ("n_chars", "long")) if c not in docs.columns})
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
