"""Document fingerprints by order MinHash, with DataFrame functions only.

A text's word k-mers are numbered by occurrence and hashed. The hash's leading bits name one of BUCKETS buckets; each
bucket selects its smallest k-mers, puts them back in text order, and hashes the tuple. Two texts agree in a bucket if
the same k-mers stand there in the same order, so moved passages count as well as changed ones, as under edit
distance. Likeness is the share of buckets that agree, of those in which either text has a k-mer.

Each step is its own column, so that arrays are computed once and lambdas read stored arrays. All array functions
used are linear in the text, apart from its sort.

Defined results: a null text is empty. Texts without words have an empty fingerprint, alike (1.0) to another empty
one only. Fewer words than a k-mer has make one short k-mer. A null id sorts below all others; rows with one id are
ordered by text hash. An empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialstats.llm import common

WORDS = 3
BITS = 6
CHOSEN = 2
#: Ids per group of neighbours (a power of two), and the bytes of group borders that may be broadcast.
GROUP_BITS = 10
BROADCAST_BYTES = 32 << 20
NO_ID = -(1 << 63)


def _bucket(x: Column) -> Column:
    return F.shiftright(x, 64 - BITS)


def with_fingerprint(df: DataFrame, text: str, out: str, words: int = WORDS, chosen: int = CHOSEN) -> DataFrame:
    """``df`` with ``out``: one long per bucket that has a k-mer; its leading bits are the bucket."""
    kept = df.columns
    df = df.withColumn("_words", F.split(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+"))
    df = df.withColumn("_hashes", F.transform(F.filter("_words", lambda w: w != ""), lambda w: F.xxhash64(w))).drop("_words")
    starts_mer = F.slice("_hashes", F.lit(1), F.greatest(F.size("_hashes") - (words - 1), F.lit(1)))
    df = df.withColumn("_plain", F.transform(starts_mer, lambda x, i: F.xxhash64(x, *(F.get("_hashes", i + j) for j in range(1, words))))).drop("_hashes")
    df = df.withColumn("_distinct", F.size(F.array_distinct("_plain")))
    # Where a k-mer repeats: sorted by (k-mer, place), a run's second, third, ... entries get their number hashed in.
    some = F.when(F.col("_distinct") < F.size("_plain"), F.col("_plain")).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_runs", F.sort_array(F.transform(some, lambda x, i: F.struct(x.alias("x"), i.alias("i")))))
    starts = F.filter(
        F.transform("_runs", lambda r, t: F.when((t == 0) | (F.get("_runs", t - 1)["x"] != r["x"]), t)),
        lambda t: t.isNotNull(),
    )
    df = df.withColumn("_starts", starts)

    def numbered(start: Column, t: Column) -> Column:
        end = F.coalesce(F.get("_starts", t + 1), F.size("_runs")) - 1
        return F.transform(
            F.sequence(start, end),
            lambda u: F.struct(
                F.get("_runs", u)["i"].alias("i"),
                F.when(u == start, F.get("_runs", u)["x"]).otherwise(F.xxhash64(F.get("_runs", u)["x"], u - start)).alias("x"),
            ),
        )

    df = df.withColumn("_full", F.sort_array(F.flatten(F.transform("_starts", numbered))))
    df = df.withColumn("_mers", F.when(F.size("_runs") > 0, F.transform("_full", lambda e: e["x"])).otherwise(F.col("_plain")))
    df = df.drop("_plain", "_distinct", "_runs", "_starts", "_full")
    df = df.withColumn("_sorted", F.sort_array("_mers"))
    least = F.filter("_sorted", lambda x, i: (i < chosen) | (_bucket(F.get("_sorted", i - chosen)) != _bucket(x)))
    df = df.withColumn("_in_order", F.array_intersect(F.col("_mers"), least)).drop("_sorted", "_mers")
    df = df.withColumn("_by", F.sort_array(F.transform("_in_order", lambda x, i: F.struct(_bucket(x).alias("b"), i.alias("i"), x.alias("x"))))).drop("_in_order")

    def same(t: Column, j: int) -> Column:
        other = F.get("_by", t + j)
        return F.when(other["b"] == F.get("_by", t)["b"], other["x"])

    first = F.filter(F.sequence(F.lit(0), F.size("_by") - 1), lambda t: (t == 0) | (F.get("_by", t - 1)["b"] != F.get("_by", t)["b"]))
    df = df.withColumn("_first", F.when(F.size("_by") > 0, first).otherwise(F.array().cast("array<int>")))
    low = (1 << (64 - BITS)) - 1
    value = F.transform(
        "_first",
        lambda t: F.shiftleft(F.get("_by", t)["b"], 64 - BITS).bitwiseOR(F.xxhash64(*(same(t, j) for j in range(chosen))).bitwiseAND(F.lit(low))),
    )
    return df.withColumn(out, value).select(*kept, out)


def likeness(left: str, right: str) -> Column:
    """Share of buckets that agree, of those that either has."""
    used = F.size(F.array_union(F.transform(left, _bucket), F.transform(right, _bucket)))
    return F.when(used == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(left, right)) / used)


def printed(signature: str) -> Column:
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def _borders(ids: DataFrame) -> DataFrame:
    """For each group of neighbouring ids the row that follows its last one, descending: (from_group, id, mark).

    Groups are ranked within groups of groups, and these within ranges of even size, so no task sorts more than its
    range, however far apart ids are; one row per range is ranked in one task.
    """
    groups = common.written(ids.groupBy("group").agg(F.max(F.struct("id", "mark")).alias("head")), "groups")
    wide = F.shiftright("group", GROUP_BITS)
    over = Window.partitionBy("wide").orderBy(F.desc("group"))
    inner = groups.withColumn("wide", wide).withColumn("next", F.lead("head").over(over))
    wides = groups.withColumn("wide", wide).groupBy("wide").agg(F.max_by("head", "group").alias("head"))
    # ids far apart make a group of groups of every row: these are ranked by ranges, and one row per range crosses over
    wides = wides.repartitionByRange(F.desc("wide")).withColumn("part", F.spark_partition_id())
    wides = common.written(wides, "wides")
    every = Window.orderBy("part")
    parts = wides.groupBy("part").agg(F.max_by("head", "wide").alias("head"))
    parts = parts.select("part", F.coalesce(F.lead("head").over(every), F.first("head").over(every)).alias("beyond"))
    inside = Window.partitionBy("part").orderBy(F.desc("wide"))
    outer = wides.withColumn("after", F.lead("head").over(inside)).join(parts, "part")
    outer = outer.select("wide", F.coalesce("after", "beyond").alias("after"))
    joined = inner.join(outer, "wide").withColumn("next", F.coalesce("next", "after"))
    return joined.select(F.col("group").alias("from_group"), F.col("next.id").alias("id"), F.col("next.mark").alias("mark"))


def with_next(rows: DataFrame, id_column: str, text: str, more: Callable[[DataFrame], DataFrame], columns: list[str]) -> DataFrame:
    """``more(rows)`` with ``next_<column>`` of the next row by descending id; after the last comes the first.

    Rows meet their neighbours in groups of 2^GROUP_BITS ids, which one shuffle makes. A group's last row finds its
    neighbour in a copy of the next group's first row. ``more`` is applied once, to rows and copies together, so that
    its work isn't done again for the ids and the copies.
    """
    number = F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID))
    rows = rows.withColumn("id", number).withColumn("mark", F.xxhash64(text)).withColumn("group", F.shiftright("id", GROUP_BITS))
    borders = common.written(_borders(rows.select("id", "mark", "group")), "borders")
    told = F.broadcast(borders) if 24 * borders.count() <= BROADCAST_BYTES else borders
    copies = rows.drop("group").join(told, ["id", "mark"]).withColumnRenamed("from_group", "group").withColumn("copy", F.lit(1))
    near = Window.partitionBy("group").orderBy("copy", F.desc("id"), F.desc("mark"))
    both = more(rows.withColumn("copy", F.lit(0)).unionByName(copies))
    for c in columns:
        both = both.withColumn(f"next_{c}", F.lead(c).over(near))
    return both.filter("copy = 0").drop("copy", "group", "mark", "id")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited, signature, edited_signature, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by as many first ones (or all) of the next
    document by descending id.
    """
    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    rows = with_next(plain, "doc_id", "text", lambda df: with_fingerprint(df, "text", "signature"), ["text", "signature"])
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = with_fingerprint(rows.drop("text", "next_text"), "edited", "edited_signature")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited",
        "signature",
        "edited_signature",
        likeness("signature", "edited_signature").alias("near_edited"),
        likeness("signature", "next_signature").alias("near_next"),
    )
