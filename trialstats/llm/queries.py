"""The registered queries of the text and vector operators: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialstats.llm import bpe, language, lexical, lines, lm, minhash, neighbours, ordered, packing, periodic, quality, substrings, urlfilter
from trialstats.llm.common import documents, remainder

DIGEST = "sha2(cast({} as binary), 256)"


def _folded(docs: DataFrame) -> DataFrame:
    return docs.withColumn("held_out", remainder("doc_id", 5) == 0)


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _folded(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    model = language.train(docs.filter("NOT held_out").select("text", "lang"))
    return language.predict(docs, model, ["doc_id", "held_out"]).select("carried.*", "lang_pred", "score")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).drop("row")


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(vectors, F.col("id") % 20 == 0)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.remove_lines(documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_removed", F.expr(DIGEST.format("kept")).alias("kept_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.round_trip(documents(spark, sf_dir), digests=True)
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(documents(spark, sf_dir)).select("doc_id", "class_id", "copy_of")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.fingerprints(documents(spark, sf_dir)).select(
        "doc_id",
        "n_chars",
        F.expr(DIGEST.format("edited")).alias("edited_sha256"),
        ordered.printed("signature").alias("fingerprint"),
        ordered.printed("edited_signature").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = _folded(spark.read.parquet(f"{sf_dir}/labels.parquet")).filter("NOT held_out")
    model = quality.train(docs, labels)
    out = quality.score(_folded(docs), model, ["doc_id", "held_out"]).select("carried.*", "score")
    return out.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", remainder("doc_id", 7) == 2)
    return lm.score(docs)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substrings.remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.expr(DIGEST.format("kept")).alias("kept_sha256"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text: from word a on, every tenth document (by crc32 of its id) repeats the p words that start there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    cut = docs.select("doc_id", "text", h.alias("h"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, periodic.words("text")).alias("words"))
    cut = cut.withColumn("n", F.coalesce(F.size("words"), F.lit(-1))).withColumn("a", F.col("g") % F.greatest("n", F.lit(1)))
    cut = cut.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    source = lambda i: F.when(i >= F.col("a"), F.col("a") + (i - F.col("a")) % F.col("p")).otherwise(i).cast("int")
    edited = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("words", source(i))), " ")
    return cut.select("doc_id", F.when(F.col("n") > 0, edited).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.collapse(_with_planted_runs(documents(spark, sf_dir)), ["doc_id"])
    printed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return out.withColumn("top", periodic.longest_run("runs")).select(
        "carried.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(printed.cast("binary"), 256).alias("runs_sha256"),
        F.expr(DIGEST.format("kept")).alias("collapsed_sha256"),
    )


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES, ["page_id"]).select("carried.page_id", "host", "path", "rule", "verdict", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_language": op1_language,
    "op2_packing": op2_packing,
    "op3_neighbours": op3_neighbours,
    "op4_line_dedup": op4_line_dedup,
    "op5_bpe": op5_bpe,
    "op6_near_dedup": op6_near_dedup,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality": op8_quality,
    "op9_lm_score": op9_lm_score,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_url_filter": op12_url_filter,
    "op13_lexical_search": op13_lexical_search,
}

ORACLES = {
    "op4_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                   generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos
            FROM documents),
        worded AS (SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w FROM lines),
        firsts AS (SELECT w, min(struct_pack(d := doc_id, p := pos)) AS f FROM worded WHERE len(w) >= 1 GROUP BY w),
        halves AS (
            SELECT w, f, unnest([
                'f' || array_to_string(w[1:len(w) // 2], ' '), 'f' || array_to_string(w[1:(len(w) - 1) // 2], ' '),
                'l' || array_to_string(w[len(w) - len(w) // 2 + 1:], ' '),
                'l' || array_to_string(w[len(w) - (len(w) - 1) // 2 + 1:], ' ')]) AS half
            FROM firsts WHERE len(w) >= 5),
        pairs AS (
            SELECT DISTINCT x.w AS a, y.w AS b FROM halves x JOIN halves y USING (half)
            WHERE y.f < x.f AND abs(len(x.w) - len(y.w)) <= 1),
        near AS (
            SELECT DISTINCT a AS w FROM pairs
            WHERE (len(a) = len(b) AND len(list_filter(range(1, len(a) + 1), lambda i: a[i] <> b[i])) = 1)
               OR (len(a) = len(b) + 1 AND len(list_filter(range(1, len(a) + 1), lambda i: list_concat(a[1:i - 1], a[i + 1:]) = b)) > 0)
               OR (len(b) = len(a) + 1 AND len(list_filter(range(1, len(b) + 1), lambda i: list_concat(b[1:i - 1], b[i + 1:]) = a)) > 0)),
        told AS (
            SELECT worded.*, len(w) >= 1 AND (w IN (SELECT w FROM near) OR struct_pack(d := doc_id, p := pos) <> f) AS gone
            FROM worded LEFT JOIN firsts USING (w))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (coalesce(gone, false)) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT coalesce(gone, false)), '')) AS kept_sha256
        FROM told GROUP BY doc_id
    """,
    "op10_substring_dedup": r"""
        WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d),
        windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM starts),
        least AS (SELECT s, min(doc_id) AS first_doc FROM windows GROUP BY s),
        hits AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM windows JOIN least USING (s) WHERE first_doc < doc_id),
        gone AS (SELECT doc_id, list(p) AS ps FROM hits GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(len(ps), 0) AS n_removed,
               sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
        FROM d LEFT JOIN gone USING (doc_id)
    """,
    "op13_lexical_search": r"""
        WITH d AS (
            SELECT doc_id, row_number() OVER () AS row,
                   regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents),
        sized AS (SELECT doc_id, row, w, len(w) AS n FROM d WHERE len(w) > 0),
        whole AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized),
        tfs AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(w) AS term FROM sized) GROUP BY row, term),
        dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        weights AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * big_n + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS weight FROM dfs, whole),
        scores AS (
            SELECT item_id, row, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l)))) AS score
            FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sized USING (row), whole
            GROUP BY item_id, row),
        ranked AS (
            SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
            FROM scores JOIN sized USING (row) WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 50
    """,
}
