import random

import brute

from trialstats.llm import lines


def wanted(rows, shortest):
    """(id, text) rows with distinct ids or equal texts -> sorted (id, n_lines, n_removed, kept)."""
    seen, out = [], []
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        kept, own = [], (t or "").split("\n")
        for line in own:
            w = brute.words(line)
            near = w in seen or len(w) >= shortest and any(len(x) >= shortest and abs(len(x) - len(w)) <= 1 and brute.edits(x, w) <= 1 for x in seen)
            if w:
                seen.append(w)
            if not near:
                kept.append(line)
        out += [(d, len(own), len(own) - len(kept), "\n".join(kept))] * rows.count((d, t))
    return sorted(out, key=repr)


def got(spark, rows, **options):
    out = lines.remove_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **options).collect()
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.kept) for r in out), key=repr)


def test_random_lines_against_all_pairs(spark):
    rng = random.Random(8)
    rows = []
    for d in range(120):
        text = []
        for _ in range(rng.randint(0, 6)):
            w = [rng.choice("abc") for _ in range(rng.randint(1, 9))]
            text.append(rng.choice([" ", "  ", "\t"]).join(w))
        rows.append((d, "\n".join(text)))
    assert got(spark, rows) == wanted(rows, 5)
    assert got(spark, rows, shortest=2) == wanted(rows, 2)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "a b c d e f\nx"), (None, "z\na b c q d e f\n"), (6, "x a b c d e"), (7, "short"), (8, "short")]
    assert got(spark, rows) == wanted(rows, 5)
    assert got(spark, []) == []


def test_hot_line_families_and_a_very_long_line(spark):
    hot = "this one line stands in every document of the table"
    long = " ".join(f"w{i}" for i in range(4000))
    rows = [(i, f"{hot}\nnumber {i} of a family of lines that differ by one\n" + (long if i % 90 == 0 else "")) for i in range(200)]
    rows.append((500, long.replace("w2000 ", "")))
    assert got(spark, rows) == wanted(rows, 5)


def test_lines_of_two_hundred_thousand_words(spark):
    rng = random.Random(3)
    words = [rng.choice(["ab", "cd", "ef"]) for _ in range(200_000)]
    other = words[:77_777] + ["new"] + words[77_778:]
    shorter = words[:150_000] + words[150_001:]
    far = ["new"] + words[1:-1] + ["new"]
    rows = [(d, "x\n" + " ".join(w)) for d, w in enumerate([words, other, shorter, far, words])]
    out = {d: (n, removed, kept) for d, n, removed, kept in got(spark, rows)}
    assert [out[d][1] for d in range(5)] == [0, 2, 2, 1, 2] and out[3][2] == rows[3][1][2:] and out[1][2] == ""


def test_many_lines_in_one_document(spark):
    rows = [(1, "\n".join(f"line {i % 30_000}" for i in range(60_000)))]
    [(_, n, removed, kept)] = got(spark, rows)
    assert (n, removed) == (60_000, 30_000) and kept == "\n".join(f"line {i}" for i in range(30_000))


def test_short_lines_go_only_as_exact_copies(spark):
    rows = [(1, "All rights reserved.\n\u6771\u4eac"), (2, "All rights  reserved.\n\nAll rights"), (3, "All rights\n\u6771\u4eac\n \n")]
    assert got(spark, rows) == wanted(rows, 5) == [(1, 2, 0, rows[0][1]), (2, 3, 1, "\nAll rights"), (3, 4, 2, " \n")]


def test_shuffle_path_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_BYTES", -1)
    frame = spark.sql("select 1L doc_id, 'a b c d e' text, 'x' id, 'y' pos, 'z' words union all select 2L, 'a b c d f', 'x', 'y', 'z'")
    out = {r.doc_id: (r.n_removed, r.kept, r.carried.pos) for r in lines.remove_lines(frame, carry=["id", "pos", "words"]).collect()}
    assert out == {1: (0, "a b c d e", "y"), 2: (1, "", "y")}


def test_main_path_has_no_python(spark, sf_dir):
    from trialstats.llm import queries

    plan = queries.QUERIES["op4_line_dedup"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
