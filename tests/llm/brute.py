"""Plain-Python counterparts of the operators, for small tables."""

import hashlib
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def without_repeats(rows, window=13):
    """(doc_id, text) rows -> sorted (doc_id, n_words, n_removed, kept)."""
    least = {}
    top = float("inf")
    key = lambda d: top if d is None else d
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, top), key(d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < key(d):
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def near_lines(lines_by_doc, distance, shortest):
    """Positions of lines within ``distance`` edits of an earlier line."""
    seen, gone = [], defaultdict(set)
    for d, lines in sorted(lines_by_doc.items()):
        for i, line in enumerate(lines):
            if len(line) >= shortest and any(abs(len(x) - len(line)) <= distance and edits(x, line) <= distance for x in seen):
                gone[d].add(i)
            if len(line) >= shortest:
                seen.append(line)
    return gone


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def shingle_counts(text, length=5):
    w = words(text)
    if not w:
        return None
    out = defaultdict(int)
    for i in range(max(1, len(w) - length + 1)):
        out[tuple(w[i : i + length])] += 1
    return out


def overlap(a, b):
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def near_classes(rows, least=0.8):
    """(doc_id, text) with distinct ids -> {doc_id: smallest id of its component}."""
    sets = {d: shingle_counts(t) for d, t in rows}
    by = defaultdict(set)
    for d, s in sets.items():
        for k in s or ():
            by[k].add(d)
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, s in sets.items():
        if s:
            # of a similar pair, more than half of the shingles are shared, so some of the first half and one is
            for b in set().union(*(by[k] for k in list(s)[: len(s) // 2 + 1])):
                if a < b or True:
                    if overlap(s, sets[b]) >= least:
                        x, y = sorted((root(a), root(b)))
                        label[y] = x
    return {d: root(d) for d in sets}
