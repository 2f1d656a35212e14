"""Byte-level BPE by backtracking: exact merges in time linear in the text.

Every piece that the pattern matches is mapped byte for byte to Latin-1, and a pyahocorasick trie of all tokens tells
the longest at a place. From the left the longest token is taken that may follow the last one; where none may, the
last token is taken back and a shorter one tried. Two tokens may stand side by side if merging their bytes would leave exactly the two;
the answers are kept. A position that once led nowhere is never tried again, so each byte is visited a bounded number
of times.

Ids of pieces met before are kept per Python worker, at most CACHED of them. Defined results: a null text is empty and
has no ids; strings that look like special tokens are ordinary text; repeated rows give equal rows; an empty table
gives none. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.llm import common

CACHED = 1_000_000
KEPT_PAIRS = 1_000_000
CODES = "doc_id long, n_tokens long, ids binary, decoded binary"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Backtracking:
    """Ids of byte strings under a vocabulary of ranks, as repeated merging of the lowest-ranked pair gives them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.tokens: list[bytes] = [b""] * size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(size)]  # a token that no merge makes is its own
        self.merges: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self._learn_halves()
        self.pairs.clear()
        self.finder = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in ranks.items():
            self.finder.add_word(token.decode("latin-1"), rank)
        self.finder.make_automaton()
        self.lengths = list(map(len, self.tokens))
        self.longest = max(self.lengths)
        self.by_text = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.shorter = [self._from(token[:-1].decode("latin-1")) for token in self.tokens]

    def _learn_halves(self) -> None:
        """Which two tokens the last merge of each token joins. Only lower ranks matter, so ascending order suffices."""
        for rank, token in enumerate(self.tokens):
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None and left < rank and right < rank and self._stay_apart(left, right):
                    self.halves[rank] = (left, right)
                    self.merges[left, right] = rank
                    break

    def compatible(self, left: int, right: int) -> bool:
        """Kept answers are looked up first by ``encode``."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        known = self.pairs[left, right] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Undo merges on both sides of the border, latest first: none undone may be later than a merge across it."""
        bound = len(self.tokens)
        while True:
            across = self.merges.get((left, right))
            if across is not None and across < bound:
                return False
            if left > right:
                bound, (_, inner) = left, self.halves[left]
                if inner != left:
                    left = inner
                    continue
                bound = right + 1
                inner = self.halves[right][0]
                if inner == right:
                    return True
                right = inner
            else:
                bound, (inner, _) = right + 1, self.halves[right]
                if inner != right:
                    right = inner
                    continue
                bound = left
                inner = self.halves[left][1]
                if inner == left:
                    return True
                left = inner

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, size = piece.decode("latin-1"), len(piece)
        lengths, shorter, pairs, longest = self.lengths, self.shorter, self.pairs, self.longest
        dead = bytearray(size + 1)
        ids: list[int] = []
        at, token = 0, self._from(text[:longest])
        while at < size:
            last = ids[-1] if ids else -1
            while token >= 0:
                end = at + lengths[token]
                if not dead[end]:
                    fits = last < 0 or pairs.get((last, token))
                    if fits is None:
                        fits = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at = end
                token = self._from(text[at : at + longest])
            else:
                dead[at] = 1
                if not ids:
                    raise ValueError("a byte of the text is no token of the vocabulary")
                last = ids.pop()
                at -= lengths[last]
                token = shorter[last]
        return ids

    def _from(self, text: str) -> int:
        """The longest token that the text starts with, or -1."""
        size = self.finder.longest_prefix(text)
        while size:
            token = self.by_text.get(text[:size])
            if token is not None:
                return token
            size -= 1
        return -1


class Chunks:
    """Ids of chunks of text: the pattern's matches one by one, with those met before kept."""

    def __init__(self, path: str, pattern: str):
        self.coder = Backtracking(read_ranks(path))
        self.matches = regex.compile(pattern).findall
        self.pieces: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _piece(self, text: str) -> bytes:
        ids = self.pieces.get(text)
        if ids is None:
            ids = np.array(self.coder.encode(text.encode()), "<u4").tobytes()
            if len(self.pieces) >= CACHED:
                self.pieces.clear()
            self.pieces[text] = ids
        return ids

    def of(self, chunks: list[str]) -> list[bytes]:
        if len(self.known) >= CACHED:
            self.known.clear()
        out = []
        for chunk in chunks:
            ids = self.known.get(chunk)
            if ids is None:
                ids = b"".join(map(self._piece, self.matches(chunk)))
                if len(chunk) <= 64:
                    self.known[chunk] = ids
            out.append(ids)
        return out


def chunks_of(path: str, pattern: str) -> Chunks:
    """One per Python worker, vocabulary and pattern."""
    return common.kept(("chunks", path, pattern), lambda: Chunks(path, pattern))


def decode(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _coded(path: str, pattern: str, digests: bool):
    def told(x: bytes):
        return hashlib.sha256(x).hexdigest() if digests else x

    kind = pa.string() if digests else pa.binary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = chunks_of(path, pattern)
        tokens = chunks.coder.tokens
        for batch in batches:
            for some in common.slices(batch):
                counts, ids, decoded = [], [], []
                for coded in common.token_bytes(common.texts_of(some), chunks):
                    counts.append(len(coded) // 4)
                    ids.append(told(coded))
                    decoded.append(told(decode(coded, tokens)))
                arrays = [some.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids, kind), pa.array(decoded, kind)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def round_trip(
    docs: DataFrame, ranks: str | None = None, pattern: str | None = None, digests: bool = False, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (little-endian unsigned 32-bit), decoded (bytes).

    ``digests`` gives the sha256 of both instead, taken where the bytes are made. ``ranks`` is a file of base64 tokens
    and ranks that every node has; the installed byte-level vocabulary by default. The cuts between chunks suit
    patterns in which a space starts a match whenever a visible character precedes or follows it.
    """
    plain = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    schema = CODES.replace("binary", "string") if digests else CODES
    return plain.mapInArrow(_coded(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN, digests), schema)
