"""Shared helpers: written tables that cut lineage, text batches as flat word arrays, hashing."""

from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialstats.session import shared_dir

#: Unicode white space, as the tokenizers' pattern sees it, plus the separators Python counts.
WHITE = "\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: A space that is no token start: white space on its left, and white space or the end on its right.
UNCUT = f"[{WHITE}] ([{WHITE}]|$)"
#: The same for Python's ``re``.
WHITE_CLASS = "[" + re.sub(r"\\x\{(\w+)\}", lambda m: chr(int(m[1], 16)), WHITE) + "]"
BATCH_BYTES = 4 << 20
#: Longest value in bytes that ``lane_hashes`` takes with the others.
LONG = 256
MASK64 = (1 << 64) - 1


_KEPT: list = []


def kept(key: tuple, make: Callable):
    """An object that a Python process keeps between tasks, one at a time: another key's goes first, with its memory."""
    if not _KEPT or _KEPT[0] != key:
        forget()
        _KEPT.extend((key, make()))
    return _KEPT[1]


def forget() -> None:
    """Drop what an earlier operator has kept in this process, and give its free memory back to the system."""
    _KEPT.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Lists that note the tables written while they are here.
_NOTES: list[list[str]] = []


@contextmanager
def noted() -> Iterator[list[str]]:
    """The paths of all tables written inside the block."""
    paths: list[str] = []
    _NOTES.append(paths)
    try:
        yield paths
    finally:
        _NOTES.remove(paths)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables whose readers are done, through the file system Spark uses."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a parquet table in the cluster's shared folder: lineage ends here, and lost executors cost nothing."""
    folder = f"{shared_dir(df.sparkSession).rstrip('/')}/trialstats-{uuid.uuid4().hex}"
    for paths in _NOTES:
        paths.append(folder)
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_bytes(df: DataFrame) -> int:
    """Size of a written table's files, through the file system Spark uses."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo: the fold a document falls in. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def row_ids(batch_rows: int, counter: list[int]) -> np.ndarray:
    """Numbers that no other task gives: the task's partition above, a running count below."""
    first = (TaskContext.get().partitionId() << 33) + counter[0]
    counter[0] += batch_rows
    return np.arange(first, first + batch_rows, dtype=np.int64)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    return pc.fill_null(batch.column(column), "")


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], lists.flatten()


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def spaced_parts(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Texts cut at every space that must start a token: (offsets per text, parts, which texts have another space and stay whole).

    A part but the first of its text stands behind a space. A text that stays whole has one empty part.
    """
    odd = pc.match_substring_regex(texts, UNCUT).to_numpy(zero_copy_only=False)
    return *_flat(pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")), odd


def chunk_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts cut before every space that must start a token, as (offsets per text, codes, distinct chunks).

    Under the byte-level pattern a space that follows a visible character, or precedes one, always starts a
    match, so the ids of a text are its chunks' ids in a row. A text with any other space is one chunk.
    """
    offsets, parts, odd = spaced_parts(texts)
    codes, distinct = _coded(parts)
    chunks = [" " + x for x in distinct.to_pylist()]
    heads = parts.take(pa.array(offsets[:-1])).to_pylist()
    for i in np.flatnonzero(odd):
        heads[i] = texts[int(i)].as_py()
    codes[offsets[:-1]] = len(chunks) + np.arange(len(heads))
    return offsets, codes, chunks + heads


def token_bytes(texts: pa.Array, coder) -> Iterator[bytes]:
    """Each text's ids as little-endian unsigned 32-bit numbers; ``coder.of`` gives those of chunks."""
    offsets, codes, chunks = chunk_codes(texts)
    known = coder.of(chunks)
    lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
    flat = np.frombuffer(b"".join(known), "<u4")
    starts = np.cumsum(lengths) - lengths
    counts = lengths[codes]
    ids = flat[ragged(starts[codes], counts)]
    ends = np.concatenate([[0], np.cumsum(counts)])[offsets]
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield ids[a:b].tobytes()


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Words (runs without ASCII white space): (offsets per text, all words)."""
    offsets, parts = _flat(pc.ascii_split_whitespace(texts))
    full = pc.greater(pc.binary_length(parts), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))]).astype(np.int64)
    return kept[offsets], parts.filter(full)


def word_codes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Words (runs without ASCII white space): (offsets per text, codes, distinct words, all words)."""
    offsets, words = words_of(pc.ascii_lower(texts) if lower else texts)
    codes, distinct = _coded(words)
    return offsets, codes, distinct, words


def hashes(values: pa.Array) -> np.ndarray:
    """64-bit hash of each value."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(x) for x in values.cast(pa.binary()).to_pylist()), np.uint64, len(values))


def lane_hashes(values: pa.Array) -> np.ndarray:
    """64-bit hash of each value, eight bytes of all values at a time; values of over LONG bytes one by one."""
    ends = np.frombuffer(values.buffers()[1], "<i4", len(values) + 1, 4 * values.offset).astype(np.int64)
    starts, sizes = ends[:-1], np.diff(ends)
    out = mixed(sizes.astype(np.uint64))
    if not len(values) or not sizes.any():
        return out
    data = np.concatenate([np.frombuffer(values.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0]), np.zeros(8, np.uint8)])
    lanes = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    starts = starts - ends[0]
    at = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    done = 0
    while len(at):
        spare = np.maximum(0, done + 8 - sizes[at]).astype(np.uint64) * np.uint64(8)
        out[at] = mixed(out[at] * np.uint64(0x9E3779B97F4A7C15) ^ (lanes[starts[at] + done] << spare))
        done += 8
        at = at[sizes[at] > done]
    for i in np.flatnonzero(sizes > LONG):
        out[i] = xxhash.xxh3_64_intdigest(values[int(i)].cast(pa.binary()).as_py())
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)
