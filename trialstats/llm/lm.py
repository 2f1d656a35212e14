"""Language-model scores: a causal self-attention model over subword ids, beside an add-one word model.

Word model. Words (ASCII letters lowered) and one end per text are counted over all training documents. The counts of
the HEAD most frequent words travel to every task; all other words meet their counts in a join, so no vocabulary is
ever gathered in one place.

Attention model. A text is its words' subword ids and an end. The next id's probability is that of its class, given
the ids before, times that of the id within its class. The second factor comes from the counts of all training words;
the first from one layer of causal self-attention with learnt weights by distance. Classes come from which ids stand
beside an id in all training texts. The layer learns from every id of every training text: in rounds, each over a share of the texts
by hash, every task takes numpy steps from the same weights over its texts, and the mean of the tasks' weights opens the
next round. Texts are learnt and scored in windows of OVERLAP + STRIDE ids, of which the last STRIDE count: every id
once, with at least OVERLAP ids before it where the text has so many. Each text's ids are made once and written; neighbours,
rounds and scores read them.

Defined results: a null text is empty and scores its end. Without training rows the word model's score is 0 and every
id is equally likely. Repeated rows give equal rows. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialstats.llm import common
from trialstats.llm.bpe import read_ranks

#: Words whose counts travel to every task: at most this many, whatever the corpus.
HEAD = 1 << 17
OVERLAP = 8
STRIDE = 24
WIDTH = 16
HIDDEN = 24
#: Classes, in GROUPS groups of as many: the most frequent ids alone, then clusters, then two for ids that training texts
#: hold less than three times. A class's probability is its group's times its own within the group, so 2 * GROUPS terms are summed per id.
GROUPS = 16
ALONE = 128
CLUSTERS = GROUPS * GROUPS - ALONE - 2
ROWS = 4096
#: Ids whose places beside others tell classes.
MARKS = 96
#: The weights of all tasks are averaged so often, each time after a share of the training texts; together the shares are all.
ROUNDS = 4
#: Windows of one step, and those held and mixed at once.
STEP = 256
MIXED = 1 << 15
#: Weights stepped at once, few enough for a core's cache.
BLOCK = 1 << 13
#: Tables with fewer windows are gone over several times; a task has a share of windows that makes it worth its own weights.
LEAST_WINDOWS = 1200 * 128
LEAST_OF_TASK = 50_000
RATE = 6e-3
CACHED = 600_000
#: New words encoded at once.
JOINED = 4096
TRAIN_BYTES = 2 << 20
#: Bytes of text whose distinct words are counted, and looked up, together.
COUNTED_BYTES = 16 << 20
ENCODED_BYTES = 8 << 20
SOME_WINDOWS = 512


class Subwords:
    """Ids of words, each as it stands after a space. Words met before are kept."""

    def __init__(self, path: str):
        ranks = read_ranks(path)
        self.coder = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.end = max(ranks.values()) + 1
        self.known: dict[str, bytes] = {}
        self.sizes = np.zeros(self.end, np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))
        self.odd = re.compile(common.WHITE_CLASS).search

    def _new(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        """Ids of distinct words. Words without white space are encoded as joined texts, and the ids cut where a word's bytes end."""
        plain = []
        for w in words:
            if self.odd(w):
                yield w, np.array(self.coder.encode_ordinary(" " + w), "<u4").tobytes()
            else:
                plain.append(w)
        for lo in range(0, len(plain), JOINED):
            some = plain[lo : lo + JOINED]
            ids = np.array(self.coder.encode_ordinary(" " + " ".join(some)), "<u4")
            ends = np.cumsum([len(w.encode()) + 1 for w in some])
            cuts = (4 * np.searchsorted(np.cumsum(self.sizes[ids]), ends, side="right")).tolist()
            blob = ids.tobytes()
            yield from zip(some, map(blob.__getitem__, map(slice, [0, *cuts[:-1]], cuts)), strict=True)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all words, first place of each word, number of each word's ids)."""
        known = self.known
        if len(known) > CACHED:
            known.clear()
        out = list(map(known.get, words))
        if at := [i for i, ids in enumerate(out) if ids is None]:
            new = dict(self._new([words[i] for i in at]))
            for i in at:
                out[i] = new[words[i]]
            known.update((w, ids) for w, ids in new.items() if len(w) <= 64)
        counts = np.fromiter(map(len, out), np.int64, len(out)) // 4
        return np.frombuffer(b"".join(out), "<u4").astype(np.int64), np.cumsum(counts) - counts, counts


def subwords_of(path: str) -> Subwords:
    """One per Python process and file."""
    return common.kept(("subwords", path), lambda: Subwords(path))


def sequences(offsets: np.ndarray, codes: np.ndarray, ids: np.ndarray, first: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids, an end behind each, and where each text begins (and the last ends)."""
    per_word = counts[codes]
    flat = ids[common.ragged(first[codes], per_word)]
    ends = np.concatenate([[0], np.cumsum(per_word)])[offsets]
    out = np.insert(flat, ends[1:], end)
    return out, ends + np.arange(len(ends))


def _kind(end: int) -> np.dtype:
    """The smallest kind of number that holds every id."""
    return np.dtype("<u2" if end < 1 << 16 else "<u4")


def packed(stream: np.ndarray, starts: np.ndarray, end: int) -> pa.Array:
    """Each text's ids as bytes."""
    kind = _kind(end)
    places = (starts * kind.itemsize).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(stream.astype(kind).tobytes())])


def unpacked(ids: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same as ``sequences`` gave."""
    kind, ids = _kind(end), ids.cast(pa.binary())
    if not len(ids):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    places = np.frombuffer(ids.buffers()[1], "<i4", len(ids) + 1, 4 * ids.offset).astype(np.int64)
    size = int(places[-1] - places[0]) // kind.itemsize
    return np.frombuffer(ids.buffers()[2], kind, size, int(places[0])).astype(np.int64), (places - places[0]) // kind.itemsize


@dataclass
class Classes:
    """The class of each id, its log10 probability within the class, and its row among the input embeddings."""

    of: np.ndarray
    within: np.ndarray
    row: np.ndarray
    size: int
    rows: int


def _cells(stream: np.ndarray, place: np.ndarray, mark: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The cells (row of an id, column of a mark before or behind it) that a stream's neighbours fall in."""
    for here, there, shift in ((stream[1:], stream[:-1], 0), (stream[:-1], stream[1:], width // 2)):
        at = place[here] >= 0
        yield place[here[at]] * width + mark[there[at]] + shift


def _placed(totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(ids met three times by frequency, each id's row among them or -1, its mark, the number of columns)."""
    ranked = np.argsort(-totals, kind="stable")
    known = ranked[: int((totals >= 3).sum())]
    place, mark = np.full(len(totals), -1), np.full(len(totals), MARKS)
    place[known] = np.arange(len(known))
    mark[ranked[:MARKS]] = np.arange(MARKS)
    return known, place, mark, 2 * MARKS + 2


def _beside(stream: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """How often each mark (and any other id) stands before and behind each known id, in one stream."""
    known, place, mark, width = _placed(totals)
    out = np.zeros(len(known) * width, np.float32)
    for cells in _cells(stream, place, mark, width):
        np.add.at(out, cells, 1)
    return out.reshape(len(known), width)


def _clusters(vectors: np.ndarray, weight: np.ndarray, seed: int) -> np.ndarray:
    """Spherical k-means into CLUSTERS."""
    rng = np.random.default_rng(seed)
    centres = vectors[rng.choice(len(vectors), CLUSTERS, replace=False, p=weight / weight.sum(dtype=np.float64))]
    for _ in range(15):
        nearest = (vectors @ centres.T).argmax(1)
        centres = np.zeros_like(centres)
        np.add.at(centres, nearest, vectors * weight[:, None])
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return (vectors @ centres.T).argmax(1)


def classed(stream: np.ndarray | None, totals: np.ndarray, spaced: np.ndarray, seed: int = 3, beside: np.ndarray | None = None) -> Classes:
    """Classes from neighbours (k-means on which frequent ids stand beside an id), weights from ``totals``.

    ``beside`` holds the neighbours' counts; they are those in ``stream`` by default.
    """
    known = _placed(totals)[0]
    size = GROUPS * GROUPS
    of = np.where(spaced, size - 2, size - 1)
    if len(known) < ALONE + CLUSTERS:
        of[known] = np.arange(len(known)) % (size - 2)
    else:
        beside = np.sqrt(_beside(stream, totals) if beside is None else beside)
        beside /= np.maximum(np.linalg.norm(beside, axis=1, keepdims=True), 1e-9)
        weight = totals[known].astype(np.float32)
        own = np.arange(len(known))
        own[ALONE:] = ALONE + _clusters(beside[ALONE:], weight[ALONE:], seed)
        # classes whose ids stand beside the same ids share a group
        mean = np.zeros((size - 2, beside.shape[1]), np.float32)
        np.add.at(mean, own, beside * weight[:, None])
        mean /= np.maximum(np.linalg.norm(mean, axis=1, keepdims=True), 1e-9)
        place = np.empty(size - 2, np.int64)
        place[np.argsort(np.linalg.svd(mean - mean.mean(0), full_matrices=False)[0][:, 0], kind="stable")] = np.arange(size - 2)
        of[known] = place[own]
    mass = totals + 0.1
    within = np.log10(mass / np.bincount(of, mass, size)[of])
    row = ROWS + of
    ranked = np.argsort(-totals, kind="stable")
    row[ranked[:ROWS]] = np.arange(ROWS)
    return Classes(of.astype(np.int16), within.astype(np.float32), row.astype(np.int64), size, ROWS + size + 1)


def _step(weights: np.ndarray, slope: np.ndarray, m: np.ndarray, v: np.ndarray, pace: np.float32) -> None:
    """Adam's step, in place; ``slope`` is used up."""
    m *= np.float32(0.9)
    m += np.float32(0.1) * slope
    v *= np.float32(0.99)
    slope *= slope
    slope *= np.float32(0.01)
    v += slope
    np.sqrt(v, out=slope)
    slope += np.float32(1e-7)
    np.divide(m, slope, out=slope)
    slope *= pace
    weights -= slope


class Attention:
    """One causal attention layer over input rows, a tanh layer, and class logits.

    Query and key only meet as their product, as do value and ``seen``: both are applied to the queries' side, so that keys
    and values are the input rows themselves. All weights lie in one array, ``weights``, of which the named ones are parts.
    """

    NAMES = ("embed", "query", "key", "value", "near", "own", "seen", "bias", "out", "shift", "inner", "inner_shift")

    def __init__(self, classes: Classes, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.classes = classes

        def normal(*shape, scale):
            return rng.normal(0, scale, shape).astype(np.float32)

        first = {"embed": normal(classes.rows, WIDTH, scale=0.3)}
        first |= {n: normal(WIDTH, WIDTH, scale=WIDTH**-0.5) for n in ("query", "key", "value")}
        first["near"] = np.zeros(OVERLAP + STRIDE, np.float32)
        first |= {n: normal(WIDTH, HIDDEN, scale=WIDTH**-0.5) for n in ("own", "seen")}
        first["bias"] = np.zeros(HIDDEN, np.float32)
        first |= {"out": normal(HIDDEN, GROUPS, scale=0.1), "shift": np.zeros(GROUPS, np.float32)}
        first |= {"inner": normal(GROUPS, HIDDEN, GROUPS, scale=0.1), "inner_shift": np.zeros((GROUPS, GROUPS), np.float32)}
        self.shapes = {n: first[n].shape for n in self.NAMES}
        self.weights = np.concatenate([first[n].ravel() for n in self.NAMES])
        for n, p in self._parts(self.weights).items():
            setattr(self, n, p)
        at = np.arange(OVERLAP, OVERLAP + STRIDE)[:, None] - np.arange(OVERLAP + STRIDE)
        self.distance, self.ahead = np.maximum(at, 0), at < 0
        self.windows_learnt = 0
        self.space: dict[str, np.ndarray] = {}

    def _parts(self, whole: np.ndarray) -> dict[str, np.ndarray]:
        ends = np.cumsum([int(np.prod(self.shapes[n])) for n in self.NAMES])
        return {n: part.reshape(self.shapes[n]) for n, part in zip(self.NAMES, np.split(whole, ends[:-1]), strict=True)}

    def __getstate__(self) -> tuple:
        return self.classes, self.weights, self.windows_learnt

    def __setstate__(self, state: tuple) -> None:
        self.__init__(state[0])
        self.load(state[1])
        self.windows_learnt = state[2]

    def _room(self, name: str, n: int, *shape: int) -> np.ndarray:
        """Memory that stays from step to step, for n rows of a shape."""
        if len(self.space.get(name, ())) < n:
            self.space[name] = np.zeros((n, *shape), np.float32)
        return self.space[name][:n]

    def windows(self, stream: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(input rows, ids to score or -1, text) of every window. ``end`` opens each text; the last row pads."""
        sizes = np.diff(starts)
        counts = -(-sizes // STRIDE)
        text = np.repeat(np.arange(len(sizes)), counts)
        goals = np.full(int(counts.sum()) * STRIDE, -1, np.int32)
        goals[common.ragged((np.cumsum(counts) - counts) * STRIDE, sizes)] = stream
        # a line of all texts, each behind OVERLAP pads and an end: windows are stretches of it
        room = counts * STRIDE + OVERLAP
        first = np.cumsum(room) - room
        line = np.full(int(room.sum()) + 1, self.classes.rows - 1, np.int16)
        line[common.ragged(first + OVERLAP + 1, sizes)] = self.classes.row.astype(np.int16)[stream]
        line[first + OVERLAP] = self.classes.row[end]
        line[first] = self.classes.rows - 1  # where a text before may have put its last id, which no window needs
        number = common.ragged(np.zeros(len(sizes), np.int64), counts)
        rows = np.lib.stride_tricks.sliding_window_view(line, OVERLAP + STRIDE)[first[text] + number * STRIDE] if len(text) else np.zeros((0, OVERLAP + STRIDE), np.int16)
        goals = goals.reshape(-1, STRIDE)
        return rows, goals, text

    def state(self) -> np.ndarray:
        """All weights in a row."""
        return self.weights.copy()

    def load(self, state: np.ndarray) -> Attention:
        self.weights[...] = state
        return self

    def fit(self, rows: np.ndarray, goals: np.ndarray, rate: float, moments: dict, rng: np.random.Generator) -> None:
        """One pass over the windows in mixed order; ``moments`` carry over from pass to pass."""
        order = rng.permutation(len(rows))
        m, v = (moments.setdefault(n, np.zeros_like(self.weights)) for n in ("first", "second"))
        slope = np.empty_like(self.weights)
        for at in range(0, len(order), STEP):
            some = order[at : at + STEP]
            np.concatenate([g.ravel() for g in self.gradients(rows[some], goals[some])[1].values()], out=slope)
            moments["step"] = step = moments.get("step", 0) + 1
            pace = np.float32(rate * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
            for lo in range(0, len(slope), BLOCK):
                _step(*(x[lo : lo + BLOCK] for x in (self.weights, slope, m, v)), pace)

    def _hidden(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """(hidden values and a one; inputs, what each sees and a one; all input rows; queries; weights; 1 / the weights' sums)."""
        n, places = rows.shape
        x, both = self._room("x", n, places, WIDTH), self._room("both", n, STRIDE, 2 * WIDTH + 1)
        self.embed.take(rows.ravel(), 0, x.reshape(-1, WIDTH), "clip")
        both[:, :, :WIDTH] = x[:, OVERLAP:]
        both[:, :, 2 * WIDTH] = 1
        q, a, seen = self._room("q", n, STRIDE, WIDTH), self._room("a", n, STRIDE, places), self._room("seen", n, STRIDE, WIDTH)
        np.matmul(both.reshape(-1, 2 * WIDTH + 1)[:, :WIDTH], self.query @ self.key.T * np.float32(WIDTH**-0.5), out=q.reshape(-1, WIDTH))
        np.matmul(q, x.transpose(0, 2, 1), out=a)
        safe = max(a.max(), -a.min()) + np.abs(self.near).max() < 40  # no exponential leaves float32's range
        a += np.where(self.ahead, np.float32(-1e9), self.near[self.distance])
        padded = rows == self.classes.rows - 1
        some = np.flatnonzero(padded.any(1))
        a[some] += np.where(padded[some], np.float32(-1e9), np.float32(0))[:, None, :]
        if not safe:
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        shares = np.reciprocal(a.reshape(-1, places) @ np.ones(places, np.float32)).reshape(n, STRIDE, 1)
        np.multiply(np.matmul(a, x, out=seen), shares, out=both[:, :, WIDTH : 2 * WIDTH])
        h = np.matmul(both.reshape(-1, 2 * WIDTH + 1), self._inward(), out=self._room("h", n * STRIDE, HIDDEN + 1))
        np.tanh(h, out=h)
        return h, both, x, q, a, shares

    def _inward(self) -> np.ndarray:
        """Weights from inputs, from what is seen and from a one to the hidden values, and a last column that tanh makes one."""
        out = np.zeros((2 * WIDTH + 1, HIDDEN + 1), np.float32)
        out[:WIDTH, :HIDDEN], out[WIDTH:-1, :HIDDEN], out[-1, :HIDDEN], out[-1, -1] = self.own, self.value @ self.seen, self.bias, 20
        return out

    def _told(self, h: np.ndarray, goals: np.ndarray) -> tuple[np.ndarray, ...]:
        """For goals in order of their groups: (their places, hidden values, exponentials in the group's and the class's softmax, where the chosen are, logs, cuts, weights)."""
        real = np.flatnonzero(goals.ravel() >= 0)
        wanted = self.classes.of[goals.ravel()[real]]
        order = np.argsort((wanted // GROUPS).astype(np.int8), kind="stable")
        real, wanted = real[order], wanted[order].astype(np.int64)
        group = wanted // GROUPS
        cuts = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
        weights = np.empty((GROUPS, HIDDEN + 1, 2 * GROUPS), np.float32)
        weights[:, :HIDDEN, :GROUPS], weights[:, HIDDEN, :GROUPS] = self.out, self.shift
        weights[:, :HIDDEN, GROUPS:], weights[:, HIDDEN, GROUPS:] = self.inner, self.inner_shift
        told, p = self._room("told", len(real), HIDDEN + 1), self._room("p", len(real), 2 * GROUPS)
        h.take(real, 0, told, "clip")
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if lo < hi:
                np.matmul(told[lo:hi], weights[k], out=p[lo:hi])
        z = p.reshape(-1, GROUPS)
        if len(z) and max(z.max(), -z.min()) > 40:
            z -= z.max(1, keepdims=True)
        chosen = np.arange(len(z)) * GROUPS
        chosen[::2] += group
        chosen[1::2] += wanted % GROUPS
        logs = z.ravel()[chosen]
        np.exp(z, out=z)
        sums = z @ np.ones(GROUPS, np.float32)
        logs -= np.log(sums)
        return real, told, p, sums, chosen, logs.reshape(-1, 2).sum(1), cuts, weights

    def gradients(self, rows: np.ndarray, goals: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy of the goals' classes, and its gradients, in the order of NAMES."""
        n, places = rows.shape
        h, both, x, q, a, shares = self._hidden(rows)
        real, told, p, sums, chosen, logs, cuts, weights = self._told(h, goals)
        scale = np.float32(1 / max(1, len(real)))
        z = p.reshape(-1, GROUPS)
        z *= (scale / sums)[:, None]
        z.ravel()[chosen] -= scale
        d_weights, d_told = np.zeros_like(weights), self._room("d_told", len(real), HIDDEN + 1)
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            if lo < hi:
                np.matmul(told[lo:hi].T, p[lo:hi], out=d_weights[k])
                np.matmul(p[lo:hi], weights[k].T, out=d_told[lo:hi])
        told *= told
        np.subtract(1, told, out=told)
        d_told *= told
        dh = self._room("dh", len(h), HIDDEN + 1)
        dh[...] = 0
        dh[real] = d_told
        inputs, inward = both.reshape(-1, 2 * WIDTH + 1), self._inward()
        d_inward = inputs.T @ dh
        d_seen, product, d_mine, ds = (self._room(k, n, STRIDE, w) for k, w in (("d_seen", WIDTH), ("product", WIDTH), ("d_mine", WIDTH), ("ds", places)))
        np.matmul(dh, inward[WIDTH:-1].T, out=d_seen.reshape(-1, WIDTH))
        d_seen *= shares
        np.multiply(d_seen, both[:, :, WIDTH : 2 * WIDTH], out=product)
        mean = (product.reshape(-1, WIDTH) @ np.ones(WIDTH, np.float32)).reshape(n, STRIDE, 1)
        np.matmul(d_seen, x.transpose(0, 2, 1), out=ds)
        ds -= mean
        ds *= a
        dq, dx, more = product, self._room("dx", n, places, WIDTH), self._room("more", n, places, WIDTH)
        np.matmul(ds, x, out=dq)
        pull = inputs[:, :WIDTH].T @ dq.reshape(-1, WIDTH) * np.float32(WIDTH**-0.5)
        np.matmul(a.transpose(0, 2, 1), d_seen, out=dx)
        dx += np.matmul(ds.transpose(0, 2, 1), q, out=more)
        np.matmul(dq.reshape(-1, WIDTH), self.key @ self.query.T * np.float32(WIDTH**-0.5), out=d_mine.reshape(-1, WIDTH))
        d_mine += np.matmul(dh, inward[:WIDTH].T, out=q.reshape(-1, WIDTH)).reshape(q.shape)
        dx[:, OVERLAP:] += d_mine
        order = np.argsort(rows.ravel().astype(np.int16, copy=False), kind="stable")
        met = rows.ravel()[order]
        heads = np.flatnonzero(np.append(True, np.diff(met) != 0))
        embed = np.zeros_like(self.embed)
        embed[met[heads]] = np.add.reduceat(dx.reshape(-1, WIDTH).take(order, 0), heads, axis=0)
        return float(-logs.sum(dtype=np.float64) * scale), {
            "embed": embed,
            "query": pull @ self.key,
            "key": pull.T @ self.query,
            "value": d_inward[WIDTH:-1, :HIDDEN] @ self.seen.T,
            "near": np.bincount(self.distance.ravel(), ds.sum(0).ravel(), places).astype(np.float32),
            "own": d_inward[:WIDTH, :HIDDEN],
            "seen": self.value.T @ d_inward[WIDTH:-1, :HIDDEN],
            "bias": d_inward[-1, :HIDDEN],
            "out": d_weights[:, :HIDDEN, :GROUPS].sum(0),
            "shift": d_weights[:, HIDDEN, :GROUPS].sum(0),
            "inner": d_weights[:, :HIDDEN, GROUPS:],
            "inner_shift": d_weights[:, HIDDEN, GROUPS:],
        }

    def class_logs(self, rows: np.ndarray, goals: np.ndarray) -> np.ndarray:
        """log10 probability of each goal's class (0 where there is no goal)."""
        real, *_, logs, _, _ = self._told(self._hidden(rows)[0], goals)
        out = np.zeros(goals.size, np.float32)
        out[real] = logs
        return (out / np.log(10)).reshape(goals.shape)

    def score(self, stream: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
        """log10 probability of each text."""
        out = np.zeros(len(starts) - 1)
        within = np.concatenate([[0.0], np.cumsum(self.classes.within[stream], dtype=np.float64)])
        out += within[starts[1:]] - within[starts[:-1]]
        rows, goals, text = self.windows(stream, starts, end)
        for at in range(0, len(rows), SOME_WINDOWS):
            cut = slice(at, at + SOME_WINDOWS)
            np.add.at(out, text[cut], self.class_logs(rows[cut], goals[cut]).sum(1, dtype=np.float64))
        return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for some in common.slices(batch, limit=COUNTED_BYTES):
            _, codes, distinct, _ = common.word_codes(some.column("text"), lower=True)
            yield pa.RecordBatch.from_arrays([distinct.cast(pa.string()), pa.array(np.bincount(codes, minlength=len(distinct)))], ["word", "n"])


def _id_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords_of(path)
        totals = np.zeros(coder.end + 1)
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                some = batch.slice(lo, 20_000)
                ids, _, counts = coder.of(some.column("word").to_pylist())
                totals += np.bincount(ids, np.repeat(some.column("c").to_numpy(), counts), coder.end + 1)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], ["id", "n"])

    return run


def _id_totals(path: str):
    """A task's counts of ids, from rows whose ids are made already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = subwords_of(path)
        totals = np.zeros(coder.end + 1)
        for stream, _ in _streams(batches, coder):
            totals += np.bincount(stream, minlength=coder.end + 1)
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], ["id", "n"])

    return run


def head_words(counts: DataFrame, size: int | None = None) -> DataFrame:
    """At most ``size`` of the most frequent words (HEAD by default): all whose count reaches a threshold.

    Thresholds are eighths of powers of two; the driver sees the number of words at each, and then the words.
    """
    size = HEAD if size is None else size
    level = F.floor(8 * F.log2("c")).cast("int")
    levels = sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r["level"])
    least, total = None, 0
    for row in levels:
        total += row["count"]
        if total > size:
            break
        least = row["level"]
    return counts.filter(level >= least) if least is not None else counts.limit(0)


def _streams(batches: Iterator[pa.RecordBatch], coder: Subwords) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids of rows of texts, or of rows whose ids are made already."""
    for batch in batches:
        if "ids" in batch.schema.names:
            for some in common.slices(batch, "ids", TRAIN_BYTES):
                yield unpacked(some.column("ids"), coder.end)
            continue
        for some in common.slices(batch, limit=TRAIN_BYTES):
            offsets, codes, distinct, _ = common.word_codes(some.column("text"), lower=True)
            yield sequences(offsets, codes, *coder.of(distinct.to_pylist()), coder.end)


def _neighbours(path: str, totals: np.ndarray):
    """A task's counts of marks beside known ids."""
    known, place, mark, width = _placed(totals)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(known) * width, np.int32)
        for stream, _ in _streams(batches, subwords_of(path)):
            for cells in _cells(stream, place, mark, width):
                np.add.at(out, cells, np.int32(1))
        at = np.flatnonzero(out)
        for lo in range(0, len(at), 100_000):
            some = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some].astype(np.int64))], ["cell", "n"])

    return run


LEARNT = "slot int, n long, state binary"


def _learnt(rows: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
    slots, n, states = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(slots, pa.int32()), pa.array(n, pa.int64()), pa.array([x.astype("<f8").tobytes() for x in states], pa.binary())], ["slot", "n", "state"])


def _round(path: str, classes: Classes, state: np.ndarray, passes: int, rate: float):
    """A task's weights after its texts, times the number of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, coder, rng, moments = Attention(classes).load(state), subwords_of(path), np.random.default_rng(2), {}
        held, count, total = [], 0, 0

        def learn() -> None:
            rows, goals = (np.concatenate(c) for c in zip(*held, strict=True))
            for _ in range(passes):
                model.fit(rows, goals, rate, moments, rng)

        for stream, starts in _streams(batches, coder):
            rows, goals, _ = model.windows(stream, starts, coder.end)
            for lo in range(0, len(rows), MIXED):
                held.append((rows[lo : lo + MIXED].copy(), goals[lo : lo + MIXED].copy()))
                count += len(held[-1][0])
                if count >= MIXED:
                    learn()
                    held, count, total = [], 0, total + count
        if count:
            learn()
        if total + count:
            yield _learnt([(TaskContext.get().partitionId(), total + count, model.state().astype(np.float64) * (total + count))])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the tasks' weights."""
    n, total = 0, None
    for batch in batches:
        for k, state in zip(batch.column("n").to_pylist(), batch.column("state").to_pylist(), strict=True):
            n += k
            total = np.frombuffer(state, "<f8") + (0 if total is None else total)
    if n:
        yield _learnt([(0, n, total)])


def train(plain: DataFrame, counts: DataFrame, documents: int, path: str) -> Attention | None:
    """The model from all training texts, given as ``text`` or ``ids``. Driver: one number per id, neighbours' counts, and weights of at most 16 groups of tasks.

    Its ``windows_learnt`` counts the windows of all rounds.
    """
    given = "ids" if "ids" in plain.columns else "text"
    if not documents:
        return None
    coder = subwords_of(path)
    met = plain.select(given).mapInArrow(_id_totals(path), "id long, n double") if given == "ids" else counts.mapInArrow(_id_counts(path), "id long, n double")
    rows = met.groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    totals = np.zeros(coder.end + 1)
    totals[rows["id"].to_numpy()] = rows["n"].to_numpy()
    totals[coder.end] = documents
    spaced = np.array([t[:1] == " " for t in map(lambda b: b.decode("latin-1"), coder.coder.token_byte_values())] + [False])
    order = np.argsort([coder.coder.encode_single_token(t) for t in coder.coder.token_byte_values()])
    spaced[: len(order)] = spaced[:-1][order]
    known, _, _, width = _placed(totals)
    beside = np.zeros(len(known) * width, np.float32)
    if len(known) >= ALONE + CLUSTERS:
        met = plain.select(given).mapInArrow(_neighbours(path, totals), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        beside[met["cell"].to_numpy()] = met["n"].to_numpy()
    classes = classed(None, totals, spaced, beside=beside.reshape(len(known), width))
    model = Attention(classes)
    # shares of a large table make one pass in all; a small one is gone over until it has given LEAST_WINDOWS
    windows = totals.sum() / STRIDE
    epochs = int(max(1, -(-LEAST_WINDOWS // windows)))
    some = plain.select(given).coalesce(int(max(1, windows // LEAST_OF_TASK)))
    for number in range(ROUNDS):
        shares = {(number * min(epochs, ROUNDS) + i) % ROUNDS for i in range(min(epochs, ROUNDS))}
        told = some.filter(F.pmod(F.xxhash64(given, F.lit(1)), F.lit(ROUNDS)).isin(*sorted(shares)))
        learnt = told.mapInArrow(_round(path, classes, model.state(), -(-epochs // ROUNDS), RATE * (1 - number / ROUNDS)), LEARNT)
        merged = learnt.repartition(16, "slot").sortWithinPartitions("slot").mapInArrow(_merged, LEARNT).toPandas()
        if len(merged):
            n = int(merged["n"].sum())
            model.load(sum(np.frombuffer(x, "<f8") for x in merged["state"]) / n)
            model.windows_learnt += n * -(-epochs // ROUNDS)
    return model


ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, ids binary, word string, tf long"


def _encoded(path: str, head: pa.Array, head_counts: np.ndarray, ends: int):
    """A row per document (word null), and one per document and word outside the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, counter = subwords_of(path), [0]
        for batch in batches:
            for some in common.slices(batch, limit=ENCODED_BYTES):
                yield from _slice(some, coder, common.row_ids(some.num_rows, counter))

    def _slice(some: pa.RecordBatch, coder: Subwords, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        offsets, codes, distinct, _ = common.word_codes(some.column("text"), lower=True)
        place = pc.fill_null(pc.index_in(distinct, value_set=head), -1).to_numpy().astype(np.int64)
        seen = np.where(place >= 0, head_counts[place], 0) if len(head_counts) else np.zeros(len(distinct), np.int64)
        document = np.repeat(np.arange(len(rows)), np.diff(offsets))
        known = np.bincount(document, seen[codes] > 0, len(rows)) + (ends > 0)
        logs = np.bincount(document, np.log10(seen + 1.0)[codes], len(rows)) + np.log10(ends + 1.0)
        stream, starts = sequences(offsets, codes, *coder.of(distinct.to_pylist()), coder.end)
        n = len(rows)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows), some.column("doc_id"), some.column("held_out"), pa.array(np.diff(offsets) + 1), pa.array(known.astype(np.int64)),
                pa.array(logs), packed(stream, starts, coder.end), pa.nulls(n, pa.string()), pa.nulls(n, pa.int64()),
            ],
            NAMES,
        )
        rare = place[codes] < 0
        pair, times = np.unique(document[rare] * len(distinct) + codes[rare], return_counts=True)
        n = len(pair)
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
        words = distinct.take(pa.array(pair % len(distinct))) if n else pa.array([], pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows[pair // len(distinct)] if n else rows[:0]), *(pa.nulls(n, k) for k in kinds), words.cast(pa.string()), pa.array(times)], NAMES
        )

    return run


NAMES = [x.split()[0] for x in ENCODED.split(", ")]
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, score double"


def _scored(path: str, model: Attention | None):
    """The documents' rows with their scores in place of their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = subwords_of(path).end
        for batch in batches:
            for some in common.slices(batch, "ids", TRAIN_BYTES):
                stream, starts = unpacked(some.column("ids"), end)
                scores = model.score(stream, starts, end) if model else -np.log10(end + 1.0) * np.diff(starts)
                others = some.drop_columns("ids")
                yield pa.RecordBatch.from_arrays([*others.columns, pa.array(scores)], [*others.schema.names, "score"])

    return run


def score(docs: DataFrame, ranks: str | None = None, id_column: str = "doc_id", text_column: str = "text", held_column: str = "held_out") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Rows whose ``held_column`` is false are learnt from. ``ranks`` is a file of base64 tokens and ranks that every node
    has; the installed byte-level vocabulary by default.
    """
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = docs.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"),
        F.col(held_column).cast("boolean").alias("held_out"),
    )
    training = plain.filter("NOT held_out")
    told = training.select("text").mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))
    counts = common.written(told, "counts")
    documents = training.count()
    words, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    total, kinds = (words or 0) + documents, distinct + (documents > 0)
    top = head_words(counts).toPandas()
    run = _encoded(path, pa.array(top["word"], pa.string()), top["c"].to_numpy(np.int64), documents)
    encoded = common.written(plain.mapInArrow(run, ENCODED), "encoded")
    texts = encoded.filter("word IS NULL").drop("word", "tf")
    model = train(texts.filter("NOT held_out").select("ids"), counts, documents, path)
    scored = common.written(texts.mapInArrow(_scored(path, model), SCORED), "scored")
    rare = encoded.filter("word IS NOT NULL").select("row", "word", "tf").join(counts, "word")
    rare = rare.groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    rows = scored.join(rare, "row", "left")
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * np.log10(total + kinds + 1.0)).alias("base_score"),
        "score",
    )
