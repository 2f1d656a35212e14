"""Best-fit packing of tokenized documents into sequences: hierarchical residual packing.

Every task tokenizes its documents and packs them best-fit, largest first. Bins that are nearly full are final.
The pieces of all other bins travel on: they are dealt by hash, anew in each round, over groups of about GROUP pieces,
so that sizes from all tasks meet in each, and every group packs its pieces by best-fit again. Rounds go on until one
group has held all that was left, or until a round gives no fewer bins than it was given; such a round is dropped.

Nulls, empty texts: the end id alone. Repeated rows and ids: packed once per row; ``row`` tells them apart. An
empty table gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from trialstats.llm import common

CAPACITY = 1024
END = 2
#: Bins with at most this many free places are final.
NEARLY_FULL = 8
#: Pieces that meet in a group of a round, on average: this bounds a task's memory, not what is carried.
GROUP = 1 << 14
CACHED = 1_000_000
#: Chunks that are encoded as one text.
JOINED = 4096
SLICE_BYTES = 8 << 20
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, seq long, shift long, carry boolean"


class Ids:
    """Ids of chunks by the tokenizer: those met before are kept as one array, and found again without Python strings."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have the cores
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # a byte-level token has one character per byte
        names = map(self.tokenizer.id_to_token, range(self.tokenizer.get_vocab_size()))
        self.widths = np.array([len(name or "") for name in names], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())
        self.lengths, self.flat = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each text, all ids)."""
        lengths, parts = [], []
        for i in range(0, len(texts), 4096):
            coded = [x.ids for x in self.tokenizer.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, coded), np.int64, len(coded)))
            parts.append(np.fromiter(chain.from_iterable(coded), "<u4", int(lengths[-1].sum())))
        return np.concatenate([np.zeros(0, np.int64), *lengths]), np.concatenate([np.zeros(0, "<u4"), *parts])

    def joined(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encoded`` of chunks that start with a space, many as one text: a chunk ends where so many bytes of ids end.

        A space between two visible characters starts a match, so the ids are those of the chunks apart. Chunks
        whose next or last character is white space are encoded apart.
        """
        plain = np.fromiter((len(x) > 1 and not x[1].isspace() and not x[-1].isspace() for x in chunks), bool, len(chunks))
        if not plain.all():
            sides = [self.joined([x for x, p in zip(chunks, plain, strict=True) if p])] if plain.any() else []
            sides.append(self.encoded([x for x, p in zip(chunks, plain, strict=True) if not p]))
            counts = np.concatenate([lengths for lengths, _ in sides])
            order = np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]), kind="stable")
            starts = np.cumsum(counts) - counts
            return counts[order], np.concatenate([ids for _, ids in sides])[common.ragged(starts[order], counts[order])]
        lengths, parts = [], []
        for i in range(0, len(chunks), JOINED):
            part = chunks[i : i + JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.cumsum(np.fromiter((len(x.encode()) for x in part), np.int64, len(part)))
            reached = np.cumsum(self.widths[ids])
            at = np.searchsorted(reached, ends)
            if len(reached) == 0 or reached[-1] != ends[-1] or (reached[at] != ends).any():
                raise ValueError("the tokenizer does not start a match at every space between visible characters")
            lengths.append(np.diff(at + 1, prepend=0))
            parts.append(ids)
        return np.concatenate([np.zeros(0, np.int64), *lengths]), np.concatenate([np.zeros(0, "<u4"), *parts])

    def places(self, chunks: pa.Array) -> np.ndarray:
        """Where distinct ``chunks``, each behind a space, are in ``lengths``; new ones are encoded, and kept up to CACHED."""
        if len(self.lengths) > len(self.known):  # those of the last call that were one too many to keep
            self.lengths = self.lengths[: len(self.known)]
            self.flat = self.flat[: int(self.lengths.sum())]
        at = pc.index_in(chunks, self.known)
        new = chunks.filter(pc.is_null(at))
        out = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(new):
            out[out < 0] = np.arange(len(self.known), len(self.known) + len(new))
            lengths, flat = self.joined([" " + x for x in new.to_pylist()])
            self.lengths, self.flat = np.concatenate([self.lengths, lengths]), np.concatenate([self.flat, flat])
            # frequent chunks come early: what is beyond the bound is encoded whenever it comes
            self.known = pa.concat_arrays([self.known, new.slice(0, max(0, CACHED - len(self.known)))])
        return out


def token_ids(texts: pa.Array, coder: Ids, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets per text, ids of all texts), with the end id behind each text.

    A text is cut before every space that must start a token; its first cut, or the whole of a text with any other
    space, is encoded by itself and not kept.
    """
    offsets, parts, odd = common.spaced_parts(texts)
    heads = parts.take(pa.array(offsets[:-1])).to_pylist()
    for i in np.flatnonzero(odd):
        heads[i] = texts[int(i)].as_py()
    rest = np.ones(len(parts), bool)
    rest[offsets[:-1]] = False
    coded = parts.filter(pa.array(rest)).dictionary_encode()
    places = coder.places(coded.dictionary)
    own, ids = coder.encoded(heads)
    base = len(coder.lengths)
    lengths = np.concatenate([coder.lengths, own, [1]])
    flat = np.concatenate([coder.flat, ids, np.array([end], "<u4")])
    codes = np.empty(len(parts), np.int64)
    codes[rest] = places[coded.indices.to_numpy(zero_copy_only=False)]
    codes[offsets[:-1]] = base + np.arange(len(heads))
    codes = np.insert(codes, offsets[1:], base + len(heads))
    counts = lengths[codes]
    ends = np.append(0, np.cumsum(counts))[offsets + np.arange(len(offsets))]
    return ends, flat[common.ragged((np.cumsum(lengths) - lengths)[codes], counts)]


def pieces_of(offsets: np.ndarray, ids: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """text, piece, start, length, ids_crc32 of each piece. A longer text gives whole pieces behind a first that may be shorter."""
    totals = np.diff(offsets)
    many = np.maximum(1, -(-totals // capacity))
    text = np.repeat(np.arange(len(totals)), many)
    piece = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    first = np.where(totals > 0, (totals - 1) % capacity + 1, 0)[text]
    start = np.where(piece > 0, first + (piece - 1) * capacity, 0)
    length = np.where(piece > 0, capacity, first)
    data, at = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), (offsets[:-1][text] + start) * 4
    crc = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)), np.int64, len(at))
    return {"text": text, "piece": piece, "start": start, "length": length, "ids_crc32": crc}


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit, largest first: (bin of each item, place in it, fill of each bin)."""
    bins, shifts = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fills: list[int] = []
    by_free: dict[int, list[int]] = {}
    free: list[int] = []  # free places that some bin has, ascending
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(free, size)
        if at < len(free):
            room = free[at]
            target = by_free[room].pop()
            if not by_free[room]:
                del by_free[room], free[at]
        else:
            room, target = capacity, len(fills)
            fills.append(0)
        bins[i], shifts[i] = target, fills[target]
        fills[target] += size
        if rest := room - size:
            if rest not in by_free:
                by_free[rest] = []
                bisect.insort(free, rest)
            by_free[rest].append(target)
    return bins, shifts, np.array(fills, np.int64)


def _packed_locally(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, counter = common.kept(("ids", path), lambda: Ids(path)), [0]
        part = TaskContext.get().partitionId()
        names = ["row", "piece", "start", "length", "ids_crc32"]
        held: list[dict[str, np.ndarray]] = []
        docs: list[pa.Array] = [pa.array([], pa.int64())]
        for batch in batches:
            for some in common.slices(batch, limit=SLICE_BYTES):
                pieces = pieces_of(*token_ids(common.texts_of(some), coder, end), capacity)
                text = pieces.pop("text")
                docs.append(some.column("doc_id").take(pa.array(text)))
                held.append(pieces | {"row": common.row_ids(some.num_rows, counter)[text]})
        columns = {x: np.concatenate([np.zeros(0, np.int64), *(h[x] for h in held)]) for x in names}
        del held
        bins, shifts, fills = best_fit(columns["length"], capacity)
        arrays = {x: pa.array(columns[x], pa.int32() if x == "piece" else pa.int64()) for x in names}
        arrays |= {"doc_id": pa.concat_arrays(docs), "seq": pa.array((part << 33) + bins), "shift": pa.array(shifts), "carry": pa.array(_carried(fills, capacity)[bins])}
        order = ["row", "doc_id", *names[1:], "seq", "shift", "carry"]
        yield pa.RecordBatch.from_arrays([arrays[x] for x in order], order)

    return run


def _carried(fills: np.ndarray, capacity: int) -> np.ndarray:
    """Which bins a group hands on: all that aren't nearly full."""
    return fills < capacity - NEARLY_FULL


def _merged(capacity: int, turn: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "row", "piece"], ascending=[False, True, True], ignore_index=True)
        bins, shifts, fills = best_fit(group["length"].to_numpy(np.int64), capacity)
        group["seq"], group["shift"] = (1 << 62) + (turn << 50) + (int(group["part"].iloc[0]) << 24) + bins, shifts
        group["carry"] = _carried(fills, capacity)[bins]
        return group[["row", "piece", "length", "seq", "shift", "carry"]]

    return run


def _moves(pieces: DataFrame, capacity: int) -> DataFrame:
    """Where the carried pieces end up: (row, piece, to, by). Rounds go on as long as they lower the number of bins."""
    names = ["row", "piece", "length", "seq", "shift"]
    # a bin has one piece at place 0
    size = [F.count("*"), F.count(F.when(F.col("shift") == 0, 1)), F.coalesce(F.sum("length"), F.lit(0))]
    level, done = pieces.filter("carry").select(names), []
    rows, bins, total = level.agg(*size).first()
    groups = turn = 0
    while bins > -(-total // capacity) and groups != 1:
        turn, groups = turn + 1, -(-rows // GROUP)
        part = F.pmod(F.xxhash64(F.lit(turn), "row", "piece"), F.lit(groups)).alias("part")
        packed = level.select(part, *names).groupBy("part").applyInPandas(_merged(capacity, turn), "row long, piece int, length long, seq long, shift long, carry boolean")
        packed = common.written(packed, "merged")
        if packed.agg(*size).first()[1] >= bins:
            break
        done.append(packed.filter(~F.col("carry")).select(names))
        level = packed.filter("carry").select(names)
        rows, bins, total = level.agg(*size).first()
    for some in done:
        level = level.unionByName(some)
    return level.select("row", "piece", F.col("seq").alias("to"), F.col("shift").alias("by"))


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = CAPACITY,
    end: int = END,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, row.

    ``tokenizer`` is a tokenizers file that every node has; the installed byte-level one by default. Only documents
    longer than ``capacity`` are cut.
    """
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    pieces = common.written(plain.mapInArrow(_packed_locally(path, capacity, end), PIECES), "pieces")
    out = pieces.join(_moves(pieces, capacity), ["row", "piece"], "left")
    return out.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        F.coalesce("to", "seq").alias("sequence_id"),
        F.coalesce("by", "shift").alias("offset"),
        "row",
    )
