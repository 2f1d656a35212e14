"""Periodic runs of words: squares caught over dyadic blocks, merged into runs.

A text is read word by word. When a block of L = 1, 2, 4, ... words at a multiple of L is complete, it gets a catcher,
which listens for its block at distances 2L - 1 to 4L - 2. Every distance belongs to one L, and the first half of a square
with that distance holds a whole block of L words, so no square passes all catchers. Each appended word ends one block
length of words per L, and the two catchers at the right distance are compared with it by a hash made from the hashes
of its halves. What a catcher tells is extended word by word, to both sides, until the words differ; matches of
neighbouring blocks at one distance are one stretch. A stretch as long as its distance is a square, and the squares of
a stretch are one run. Runs are kept with their smallest period: a longer period of the same stretch is a multiple of it.

All words of a slice of texts are appended at once, level by level: the same comparisons, in arrays. At a level only
texts take part that are long enough for a run there, so work is n log n words at most.

Blocks are compared by 64-bit hashes (a false match: about one in 10^19 comparisons); extensions compare words.

Defined results: a null or blank text has no words and no runs, and keeps the empty text. Repeated rows and ids: one result
per row. A text of any length is read whole, by one task. An empty table gives no rows. Other columns are only carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialstats.llm import common

EXPONENT = 4
SHORTEST = 6
SLICE_BYTES = 2 << 20
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUN_ARROW = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)


def _caught(place: np.ndarray, room: np.ndarray, names: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of a catcher's block, distance) of every match at this level."""
    distance = 2 * block - 1 + ((place + 1) & (block - 1))
    whole = room >= block
    here = np.arange(len(place))
    at, by = [], []
    for _ in range(2):
        hit = np.flatnonzero((names[here - distance] == names) & whole & (place >= distance))
        at.append(hit - distance[hit])
        by.append(distance[hit])
        distance = distance + block
    return np.concatenate(at), np.concatenate(by)


def _steps(codes: np.ndarray, place: np.ndarray, distance: np.ndarray, limit: np.ndarray, way: int) -> np.ndarray:
    """How many words from ``place`` on, in direction ``way``, equal the words ``distance`` behind them."""
    steps = np.zeros(len(place), np.int64)
    going = np.flatnonzero(steps < limit)
    while len(going):
        i = place[going] + way * steps[going]
        going = going[codes[i] == codes[i - distance[going]]]
        steps[going] += 1
        going = going[steps[going] < limit[going]]
    return steps


def runs_of(offsets: np.ndarray, codes: np.ndarray, exponent: int = EXPONENT, shortest: int = SHORTEST) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of every run with at least ``exponent`` >= 2 periods and ``shortest`` words."""
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)
    known = np.zeros((2, len(codes)), np.int64)  # period and end of a run found before, for each of its words
    found: dict[tuple[int, int], int] = {}
    at = np.arange(len(codes))
    place, room = at - offsets[:-1][text], offsets[1:][text] - at
    names = common.mixed((codes.astype(np.uint64) + np.uint64(1)) * _ODD[0])
    block = 1
    while True:
        here = sizes[text[at]] >= max(shortest, exponent * (2 * block - 1))
        if not here.all():
            at, place, room, names = at[here], place[here], room[here], names[here]
        if not len(at):
            break
        first, by = _caught(place, room, names, block)
        if len(first):
            order = np.lexsort((first, by))
            first, by = at[first[order]], by[order]
            heads = np.flatnonzero(np.append(True, (np.diff(first) != block) | (np.diff(by) != 0)))
            last, first, by = first[np.append(heads[1:], len(first)) - 1], first[heads], by[heads]
            reach = last + block + by
            enough = np.maximum(shortest - by, (exponent - 1) * by)
            period = known[0, first]
            old = (period > 0) & (by % np.maximum(period, 1) == 0) & (reach <= known[1, first])
            some = np.flatnonzero((reach - first - by >= ((enough + 1) // block - 1) * block) & ~old)
            first, by, reach = first[some], by[some], reach[some]
            begin = first - _steps(codes, first - 1 + by, by, first - offsets[text[first]], -1)
            end = reach + _steps(codes, reach, by, offsets[text[first] + 1] - reach, 1)
            for s, e, q in zip(begin.tolist(), end.tolist(), by.tolist(), strict=True):  # ascending distances
                if e - s >= max(shortest, exponent * q) and found.setdefault((s, e), q) == q:
                    known[0, s:e], known[1, s:e] = q, e
        ahead = np.roll(names, -block)
        names = common.mixed(names * _ODD[0] + ahead * _ODD[1])
        block *= 2
    rows = np.array(sorted((s, q, e) for (s, e), q in found.items()), np.int64).reshape(-1, 3)
    start, period, end = rows.T
    return text[start], start - offsets[text[start]], end - start, period


def _collapsed(exponent: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        for batch in batches:
            for some in common.slices(batch, limit=SLICE_BYTES):
                yield from told(some)

    def told(some: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        offsets, codes, _, words = common.word_codes(common.texts_of(some))
        text, start, length, period = runs_of(offsets, codes, exponent, shortest)
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, offsets[text] + start + period, 1)
        np.add.at(edge, offsets[text] + start + length, -1)
        stays = np.cumsum(edge[:-1]) == 0
        cuts = np.append(0, np.cumsum(stays))[offsets].astype(np.int32)
        kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), words.filter(pa.array(stays)).cast(pa.string())), " ")
        ends = np.searchsorted(text, np.arange(len(offsets))).astype(np.int32)
        runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(RUN_ARROW))
        names = [x for x in some.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays(
            [*(some.column(x) for x in names), pa.array(np.diff(offsets), pa.int64()), pa.ListArray.from_arrays(pa.array(ends), runs), kept],
            [*names, "n_words", "runs", "kept"],
        )

    return run


def words(text: str) -> Column:
    """The words of a text column: runs without ASCII white space."""
    return F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def collapse(docs: DataFrame, carry: list[str], text_column: str = "text", exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """One row per row of ``docs``: ``carried`` (struct of ``carry``), n_words, runs (by start, then period), kept.

    ``kept`` are the words left, joined by one space, when every run keeps its first period only.
    """
    plain = docs.select(F.struct(*(F.col(c) for c in carry)).alias("carried"), F.col(text_column).cast("string").alias("text"))
    kind = plain.schema["carried"].dataType.simpleString()
    return plain.mapInArrow(_collapsed(exponent, shortest), f"carried {kind}, n_words long, runs {RUNS}, kept string")


def longest_run(runs: str) -> Column:
    """The run with the greatest exact length / period; ties: the first, as runs are sorted. Null without runs."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, r: F.when(more(best, r), r).otherwise(best))
