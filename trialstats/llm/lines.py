"""Line dedup across documents by a deletion-neighbourhood join, with DataFrame functions only.

A line is a sequence of words. It is removed if an earlier line (by id, text hash, place) has the same words or is one
edit away: one word inserted, removed or replaced. Every line emits hashed keys of itself with word i removed, and of
itself cut at i. Lines that share a key are all within one edit of each other, so it is enough that each meets the
earliest with that key: pairs stay linear in a bucket, and none is lost. The word edit distance is then verified.

Two exact steps come first. Equal lines are one, found by hash with map-side combination, so a line of a third of all
documents costs one row per task. And as one edit leaves the first or the last half of a line untouched, only lines
that share a half with another line, at a length that one edit allows, emit their variants.

Lines with fewer than SHORTEST words go if an earlier line has the same words; one edit says little about them, so they
neither have nor are near lines. Lines without a word are never removed. A line of any length takes time in proportion to
its words: variants come from running sums over one row per word. Defined results: a null text is
empty and has one empty line. Rows with the same id and text are one document. A null id counts as the largest. An
empty table gives no rows. Other columns are only carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialstats.llm import common

SHORTEST = 5
BROADCAST_BYTES = 32 << 20
NO_ID = (1 << 63) - 1
PLACE = ["id", "mark", "pos"]
LINE = ["one", "two"]


def _word_hashes(line: Column) -> Column:
    return F.transform(F.filter(F.split(line, "[\\x20\\x09-\\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _exploded(keyed: DataFrame) -> DataFrame:
    """One row per line: id, mark, pos, words (hashes)."""
    lines = keyed.select("id", "mark", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.select(*PLACE, _word_hashes(F.col("line")).alias("words"))


def _halves(words: str) -> list[Column]:
    """Hashes of the first and last half, for the line's own length and for one word less."""
    out = []
    for less in (0, 1):
        half = F.floor((F.size(words) - less) / 2).cast("int")
        out.append(F.xxhash64(F.lit("first"), half, F.slice(words, F.lit(1), half)))
        out.append(F.xxhash64(F.lit("last"), half, F.slice(words, F.size(words) - half + 1, half)))
    return out


def _halved(hash64: Column) -> list[Column]:
    """The low and high 31 bits: sums of them over any line stay within a long."""
    return [hash64.bitwiseAND(F.lit(0x7FFFFFFF)), F.shiftrightunsigned(hash64, 33)]


def _variants(lines: DataFrame) -> DataFrame:
    """A row per key: the line without word i, for each i; and the line cut at i, which such a variant of another may equal.

    A sequence's hash is the sum of its words' hashes by place, so one running sum per line gives all variants: words
    ahead of the missing one keep their place, those behind it move up. Lines of any length cost the same per word.
    """
    # whole lines are shuffled, eight bytes a word; their words' rows are already where the sums need them
    words = lines.repartition(*LINE).select(*PLACE, *LINE, F.size("words").alias("n"), F.posexplode("words").alias("i", "word"))
    here, moved = _halved(F.xxhash64("word", "i")), _halved(F.xxhash64("word", F.col("i") - 1))
    line = Window.partitionBy(*LINE).orderBy("i")
    ahead = line.rowsBetween(Window.unboundedPreceding, -1)
    line = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    words = words.select("*", *(c.alias(f"here{k}") for k, c in enumerate(here)), *(c.alias(f"moved{k}") for k, c in enumerate(moved)))
    none = F.lit(0).cast("long")
    summed = words.select(
        *PLACE,
        *LINE,
        "n",
        "i",
        *(F.sum(f"here{k}").over(line).alias(f"all{k}") for k in (0, 1)),
        *(
            (F.sum(f"moved{k}").over(line) - F.col(f"moved{k}") + F.coalesce(F.sum(F.col(f"here{k}") - F.col(f"moved{k}")).over(ahead), none)).alias(f"without{k}")
            for k in (0, 1)
        ),
    )
    cut = F.xxhash64("i", "all0", "all1")
    end = F.when(F.col("i") == F.col("n") - 1, F.array(F.xxhash64("n", "all0", "all1"))).otherwise(F.array().cast("array<long>"))
    keys = F.concat(F.array(F.xxhash64("i", "without0", "without1"), cut), end)
    return summed.select(*PLACE, *LINE, F.explode(keys).alias("key"))


def _one_edit(a: str, b: str) -> Column:
    """Whether two word lists are at most one inserted, removed or replaced word apart."""
    differs = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    same = F.array_position(differs, True).cast("int") - 1  # words in common at the start; -1: equal

    def rest(words: str, skip: int) -> Column:
        return F.slice(words, same + 1 + skip, F.greatest(F.size(words) - same - skip, F.lit(0)))

    more = F.size(a) - F.size(b)
    apart = F.when(more == 0, rest(a, 1) == rest(b, 1)).when(more == 1, rest(a, 1) == rest(b, 0)).when(more == -1, rest(a, 0) == rest(b, 1))
    return F.when(same < 0, F.lit(True)).otherwise(F.coalesce(apart, F.lit(False)))


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _near_lines(keyed: DataFrame, firsts: DataFrame) -> DataFrame:
    """(one, two) of every distinct line that is one edit from an earlier one."""
    firsts = firsts.filter("long")
    halves = firsts.select(*LINE, F.explode(F.array_distinct(F.array("h0", "h1", "h2", "h3"))).alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    hopeful = halves.join(shared, "half", "left_semi").select(*LINE).distinct()
    hopeful = common.written(firsts.join(hopeful, LINE, "left_semi").select(*PLACE, *LINE), "hopeful")
    told = _small(hopeful, 40 * hopeful.count())
    documents = _exploded(keyed.join(told.select("id", "mark").distinct(), ["id", "mark"], "left_semi"))
    lines = common.written(documents.join(told, PLACE).dropDuplicates(LINE), "candidates")
    variants = _variants(lines)
    first = F.min(F.struct(*PLACE, *LINE)).alias("first")
    earliest = variants.groupBy("key").agg(first, F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = variants.join(earliest, "key").select(*LINE, F.col("first.one").alias("one_"), F.col("first.two").alias("two_"))
    pairs = pairs.filter("one <> one_ OR two <> two_").distinct()
    left = lines.select(*LINE, F.col("words").alias("a"))
    right = lines.select(F.col("one").alias("one_"), F.col("two").alias("two_"), F.col("words").alias("b"))
    return pairs.join(left, LINE).join(right, ["one_", "two_"]).filter(_one_edit("a", "b")).select(*LINE).distinct()


def remove_lines(
    docs: DataFrame, shortest: int = SHORTEST, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """One row per row of ``docs``: doc_id, ``carried``, n_lines, n_removed, kept (the lines left)."""
    number, text = F.col(id_column).cast("long"), F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    keyed = docs.select(
        number.alias("own"),
        F.coalesce(number, F.lit(NO_ID)).alias("id"),
        F.xxhash64(text).alias("mark"),
        text.alias("text"),
        F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry or [])).alias("carried"),
    )
    plain = keyed.select("id", "mark", "text")
    words = _exploded(plain).filter(F.size("words") > 0)
    hashed = words.select(*PLACE, (F.size("words") >= shortest).alias("long"), F.xxhash64("words").alias("one"), F.xxhash64(F.lit(1), "words").alias("two"), *(h.alias(f"h{i}") for i, h in enumerate(_halves("words"))))
    lines = common.written(hashed, "lines")
    place = F.min(F.struct(*PLACE)).alias("first")
    firsts = lines.groupBy(*LINE).agg(place, F.count("*").alias("n"), F.max("long").alias("long"), *(F.min(f"h{i}").alias(f"h{i}") for i in range(4)))
    firsts = common.written(firsts.select(*LINE, "first.*", "n", "long", "h0", "h1", "h2", "h3"), "firsts")
    near = common.written(_near_lines(plain, firsts).withColumn("near", F.lit(True)), "near")
    repeated = firsts.join(near, LINE, "left").filter("n > 1 OR near").select(*LINE, F.struct(*PLACE).alias("first"), "near")
    repeated = common.written(repeated, "repeated")
    gone = lines.select(*PLACE, *LINE).join(_small(repeated, 64 * repeated.count()), LINE).filter(F.col("near").isNotNull() | (F.struct(*PLACE) != F.col("first")))
    gone = common.written(gone.groupBy("id", "mark").agg(F.collect_set("pos").alias("gone")), "gone")
    size = gone.agg(F.sum(24 + 4 * F.size("gone"))).first()[0] or 0
    rows = keyed.join(_small(gone, size), ["id", "mark"], "left").withColumn("own_lines", F.split("text", "\n"))
    places = F.array_except(F.sequence(F.lit(0), F.size("own_lines") - 1), "gone")  # by hash, in order
    left = F.array_join(F.transform(places, lambda i: F.get("own_lines", i)), "\n")
    return rows.select(
        F.col("own").alias("doc_id"),
        "carried",
        F.size("own_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("kept"),
    )
