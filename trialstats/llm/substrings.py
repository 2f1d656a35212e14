"""Substring dedup by super-k-mers: windows of consecutive words that an earlier document has too are removed.

A window's minimiser is the smallest hash among its shorter word runs. Consecutive windows with one minimiser travel
as one packed string to the minimiser's bucket, so equal windows meet, and a text travels about three times instead
of once per window. A bucket sorts its windows and tells every one whose smallest document id isn't its own.

Hot passages: within a slice of documents, in ascending id, only the first document with a packed string sends it;
the others' windows are known to repeat at once. So a passage sends one string per slice, not one per document.

Defined results: a null text has no words. Rows of one id never remove each other's words (not "smaller"), and a null
id counts as the largest. Repeated rows get equal results. An empty table gives no rows. Other columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.llm import common

WINDOW = 13
#: Words of the runs whose hashes compete to be the minimiser.
RUN = 5
SLICE_BYTES = 8 << 20
#: Rows of documents with removals: their ids are broadcast up to this many bytes, and joined by shuffle beyond.
BROADCAST_BYTES = 32 << 20
NO_ID = np.iinfo(np.int64).max
SPANS = "doc_id long, mark long, spans binary"
_SEEDS = np.random.default_rng(20240501).integers(1, 1 << 63, (2, 64), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _starts(offsets: np.ndarray, total: int, length: int) -> np.ndarray:
    """Which word positions start a run of ``length`` words inside one text."""
    ends = np.repeat(offsets[1:], np.diff(offsets))
    return np.arange(total) + length <= ends


def _run_hash(words: np.ndarray, length: int, seeds: np.ndarray) -> np.ndarray:
    """Hash of the ``length`` words from each position, for positions that have so many behind them."""
    out = np.zeros(max(0, len(words) - length + 1), np.uint64)
    for j in range(length):
        out += words[j : j + len(out)] * seeds[j]
    return common.mixed(out)


def super_kmers(offsets: np.ndarray, words: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of windows, minimiser) of each group of consecutive windows with one minimiser."""
    total = len(words)
    valid = _starts(offsets, total, window)
    if not valid.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    runs = _run_hash(words, run, _SEEDS[0])
    n = total - window + 1
    least, place = runs[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window - run + 1):
        smaller = runs[j : j + n] < least
        least[smaller] = runs[j : j + n][smaller]
        place[smaller] = j
    place += np.arange(n)
    at = np.flatnonzero(valid[:n])
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (np.diff(place[at]) != 0)
    heads = np.flatnonzero(new)
    return at[heads], np.diff(np.append(heads, len(at))), least[at[heads]]


def _sent(window: int, run: int, buckets: int):
    """Per slice of documents: packed strings by bucket, and spans already known to repeat."""

    def run_sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for some in common.slices(batch, limit=SLICE_BYTES):
                yield from _slice(_once(some), squeeze)

    def _once(some: pa.RecordBatch) -> pa.RecordBatch:
        some = some.sort_by([("doc_id", "ascending"), ("mark", "ascending")])
        ids, marks = (some.column(x).to_numpy() for x in ("doc_id", "mark"))
        return some.filter(pa.array(np.append(True, (np.diff(ids) != 0) | (np.diff(marks) != 0))))

    def _slice(some: pa.RecordBatch, squeeze) -> Iterator[pa.RecordBatch]:
        offsets, words = common.words_of(some.column("text"))
        first, count, least = super_kmers(offsets, common.lane_hashes(words), window, run)
        if not len(first):
            return
        lengths = pc.binary_length(words).to_numpy() + 1  # and a space
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        one = pa.LargeListArray.from_arrays(pa.array([0, len(words)], pa.int64()), words.cast(pa.large_binary()))
        buffer = pc.binary_join(one, pa.scalar(b" ", pa.large_binary()))[0].as_py() + b" "
        row = np.searchsorted(offsets, first, side="right") - 1
        docs = some.column("doc_id").to_numpy()[row]
        marks = some.column("mark").to_numpy()[row]
        start = first - offsets[row]
        seen: dict[bytes, int] = {}
        strings, sent, known = [], [], {}
        for i, (a, b, doc) in enumerate(zip(ends[first].tolist(), ends[first + count + window - 1].tolist(), docs.tolist(), strict=True)):
            packed = buffer[a:b]
            if seen.setdefault(packed, doc) == doc:  # ids ascend, so the first is the smallest
                strings.append(packed)
                sent.append(i)
            else:
                known.setdefault(int(row[i]), []).append((start[i], count[i]))
        at = np.array(sent, np.int64)
        bucket = (least[at] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.append(np.unique(bucket[order], return_index=True)[1], len(order))
        rows = {"bucket": [], "doc_id": [], "mark": [], "spans": [], "entries": [], "packed": []}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            some_at = at[order[a:b]]
            joined = [strings[k] for k in order[a:b]]
            sizes = np.fromiter(map(len, joined), np.int64, len(joined))
            rows["bucket"].append(int(bucket[order[a]]))
            rows["doc_id"].append(None)
            rows["mark"].append(None)
            rows["spans"].append(None)
            rows["entries"].append(np.stack([docs[some_at], marks[some_at], start[some_at], sizes]).astype("<i8").tobytes())
            rows["packed"].append(squeeze(b"".join(joined)))
        for r, spans in known.items():
            rows["bucket"].append((r * 7919) % buckets)
            rows["doc_id"].append(some.column("doc_id")[r].as_py())
            rows["mark"].append(some.column("mark")[r].as_py())
            rows["spans"].append(np.array(spans, "<i4").tobytes())
            rows["entries"].append(None)
            rows["packed"].append(None)
        for lo in range(0, len(rows["bucket"]), 512):
            yield pa.RecordBatch.from_pydict({k: v[lo : lo + 512] for k, v in rows.items()}, schema=SENT_ARROW)

    return run_sent


SENT = "bucket int, doc_id long, mark long, spans binary, entries binary, packed binary"
SENT_ARROW = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("spans", pa.binary()), ("entries", pa.binary()), ("packed", pa.binary())])
SPANS_ARROW = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("spans", pa.binary())])


def repeats(entries: np.ndarray, packed: bytes, window: int) -> Iterator[tuple[int, int, int]]:
    """(entry, first window, number of windows) of every run of windows that a smaller document has as well.

    ``entries``: document, row mark, first word and bytes of each packed string.
    """
    ends = np.cumsum(entries[3])
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    texts = pa.StringArray.from_buffers(len(ends), offsets.buffers()[1], pa.py_buffer(packed))
    cuts, words = common.words_of(texts)
    words = common.lane_hashes(words)
    at = np.flatnonzero(_starts(cuts, len(words), window))
    one, two = (_run_hash(words, window, s)[at] for s in _SEEDS)
    entry = np.searchsorted(cuts, at, side="right") - 1
    doc = entries[0][entry]
    order = np.lexsort((doc, two, one))
    same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
    heads = np.flatnonzero(np.append(True, ~same))
    least = np.repeat(doc[order][heads], np.diff(np.append(heads, len(order))))
    flagged = np.zeros(len(at), bool)
    flagged[order] = doc[order] > least
    hit = np.flatnonzero(flagged)
    if not len(hit):
        return
    breaks = np.append(True, (np.diff(hit) > 1) | (np.diff(entry[hit]) != 0))
    begin = np.flatnonzero(breaks)
    for a, n in zip(hit[begin].tolist(), np.diff(np.append(begin, len(hit))).tolist(), strict=True):
        yield int(entry[a]), int(at[a] - cuts[entry[a]]), n


def _found(window: int):
    """Rows sorted by bucket: the spans of each bucket, one bucket in memory at a time."""

    def told(blobs: list[tuple[bytes, bytes]], expand) -> pa.RecordBatch:
        entries = np.concatenate([np.frombuffer(e, "<i8").reshape(4, -1) for e, _ in blobs], axis=1)
        spans: dict[tuple[int, int], list] = {}
        for e, skip, n in repeats(entries, b"".join(expand(p) for _, p in blobs), window):
            spans.setdefault((int(entries[0, e]), int(entries[1, e])), []).append((int(entries[2, e]) + skip, n))
        return _batch(spans)

    def _batch(spans: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"doc_id": [k[0] for k in spans], "mark": [k[1] for k in spans], "spans": [np.array(v, "<i4").tobytes() for v in spans.values()]},
            schema=SPANS_ARROW,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.forget()
        expand = zstandard.ZstdDecompressor().decompress
        held, blobs = None, []
        for batch in batches:
            plain = batch.filter(pc.is_valid(batch.column("spans")))
            yield plain.select(["doc_id", "mark", "spans"])
            for bucket, entries, packed in zip(*(batch.column(x).to_pylist() for x in ("bucket", "entries", "packed")), strict=True):
                if entries is None:
                    continue
                if bucket != held and blobs:
                    yield told(blobs, expand)
                    blobs = []
                held = bucket
                blobs.append((entries, packed))
        if blobs:
            yield told(blobs, expand)

    return run


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in common.slices(batch):
                rows = []
                for text, spans in zip(some.column("text").to_pylist(), some.column("spans").to_pylist(), strict=True):
                    words = text.encode().split()
                    total = len(words)
                    if spans:
                        edge = np.zeros(total + 1, np.int64)
                        for piece in spans:
                            first, count = np.frombuffer(piece, "<i4").reshape(-1, 2).T
                            np.add.at(edge, first, 1)
                            np.add.at(edge, first + count + window - 1, -1)
                        keep = np.cumsum(edge[:total]) == 0
                        words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                    rows.append((total, total - len(words), b" ".join(words).decode()))
                n, gone, kept = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [*(some.column(x) for x in some.schema.names if x not in ("text", "spans")), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                    [*(x for x in some.schema.names if x not in ("text", "spans")), "n_words", "n_removed", "kept"],
                )

    return run


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, run: int = RUN, id_column: str = "doc_id", text_column: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, n_removed, kept (words left, joined by one space), and ``carried``.

    ``carried`` is a struct of the columns named in ``carry``.
    """
    spark = docs.sparkSession
    buckets = max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    number, text = F.col(id_column).cast("long"), F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    keyed = docs.select(
        number.alias("own"),
        F.coalesce(number, F.lit(NO_ID)).alias("doc_id"),
        F.xxhash64(text).alias("mark"),
        text.alias("text"),
        F.struct(F.lit(0).alias("_"), *(F.col(c) for c in carry or [])).alias("carried"),
    )
    sent = keyed.select("doc_id", "mark", "text").mapInArrow(_sent(window, run, buckets), SENT)
    found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_found(window), SPANS)
    spans = common.written(found.groupBy("doc_id", "mark").agg(F.collect_list("spans").alias("spans")), "spans")
    rows = spans.count()
    if 16 * rows <= BROADCAST_BYTES:
        ids = F.broadcast(spans.select("doc_id", "mark"))
        plain = keyed.join(ids, ["doc_id", "mark"], "left_anti").withColumn("spans", F.lit(None).cast("array<binary>"))
        joined = keyed.join(ids, ["doc_id", "mark"], "left_semi").join(spans, ["doc_id", "mark"], "left").unionByName(plain)
    else:
        joined = keyed.join(spans, ["doc_id", "mark"], "left")
    kept = joined.select(F.col("own").alias("doc_id"), "carried", "text", "spans")
    kind = kept.schema["carried"].dataType.simpleString()
    return kept.mapInArrow(_kept(window), f"doc_id long, carried {kind}, n_words long, n_removed long, kept string")
