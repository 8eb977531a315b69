"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from posttide.llm import (bpe, centroids, decontaminate, langmodel, language, lexical, licenses, quality, simhash,
                          substring, tokencount, tokenfiles, topk)
from posttide.session import scratch_path

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTRY[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def remainder(modulus: int):
    """The share of a document: CRC-32 of its id as text, modulo `modulus`; a null id has remainder 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus, F.lit(0))


@query
def op1_substring_dedup(spark, sf):
    found = substring.remove_repeats(table(spark, sf, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE["op1_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     w AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k
           FROM d, unnest(range(1, len(ws) - 33)) AS t(i)),
     repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
     gone AS (SELECT DISTINCT r, i + j AS p FROM repeated, range(35) AS t(j)),
     words AS (SELECT r, p, ws[p] AS word FROM d, unnest(range(1, len(ws) + 1)) AS t(p)),
     kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS txt FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
     cut AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(txt, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN cut USING (r)
"""


@query
def op2_simhash_near_dedup(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"))


def byte_bpe(spark: SparkSession, docs: DataFrame, keep: list[str]) -> DataFrame:
    """Token ids and, from them again, the bytes of every text."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=keep), ranks)


@query
def op4_byte_bpe(spark, sf):
    found = byte_bpe(spark, table(spark, sf, "documents"), ["doc_id"])
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op5_ppm_scores(spark, sf):
    docs = table(spark, sf, "documents")
    found = langmodel.score(docs, remainder(7) != 2, keep=["doc_id"])
    return found.select("doc_id", (remainder(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens",
                        "base_score", "score")


@query
def op8_token_counts(spark, sf):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        model = file.read()
    return tokencount.count_tokens(table(spark, sf, "documents"), model, keep=["doc_id"])


@query
def op3_quality_by_compression(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, table(spark, sf, "labels"), remainder(5) != 0)
    found = quality.score(docs, model, keep=["doc_id"])
    return found.select("doc_id", (remainder(5) == 0).alias("held_out"), "score",
                        (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op9_language_id(spark, sf):
    docs = table(spark, sf, "documents")
    model = language.fit(docs, remainder(3) != 1)
    found = language.identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", (remainder(3) == 1).alias("held_out"), "lang_pred", "score")


@query
def op6_license_scan(spark, sf):
    return licenses.scan_licenses(table(spark, sf, "documents"), keep=["doc_id"])


@query
def op6_license_spans(spark, sf):
    """Passages at words instead of whole lines. No SQL: that of op6_license_scan holds the rule of whole lines."""
    return licenses.scan_license_spans(table(spark, sf, "documents"), keep=["doc_id"])


@query
def op7_exact_top_k(spark, sf):
    return topk.top_k(table(spark, sf, "embeddings"), k=5, every=50)


ORACLE["op7_exact_top_k"] = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id,
                  [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
           FROM embeddings
           WHERE embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
     scored AS (SELECT q.r, q.vec_id AS query_id, c.vec_id,
                       CAST(list_dot_product([CAST(x AS DOUBLE) FOR x IN q.w], [CAST(x AS DOUBLE) FOR x IN c.w]) AS BIGINT)
                           AS score, c.r AS other
                FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.w) = len(c.w)),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other) AS k FROM scored)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM ranked WHERE k <= 5
"""


@query
def op10_benchmark_decontamination(spark, sf):
    return decontaminate.find_passages(table(spark, sf, "documents"), table(spark, sf, "benchmark"), keep=["doc_id"])


@query
def op11_ranked_search(spark, sf):
    return lexical.rank_documents(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


ORACLE["op11_ranked_search"] = r"""
WITH fold(a, b, terms) AS (VALUES ('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz',
                                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')),
     d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), a, b), terms) AS ts
           FROM documents, fold),
     q AS (SELECT row_number() OVER () AS i, item_id,
                  list_distinct(regexp_extract_all(translate(coalesce(text, ''), a, b), terms)) AS ts FROM benchmark, fold),
     words AS (SELECT r, unnest(ts) AS term FROM d),
     tfs AS (SELECT r, term, count(*) AS tf FROM words GROUP BY ALL),
     dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
     totals AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms
                FROM d WHERE len(ts) > 0),
     asked AS (SELECT i, item_id, unnest(ts) AS term FROM q),
     weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
                 FROM dfs, totals),
     scored AS (SELECT i, item_id, r, CAST(sum(w * ((1000000000 * tf) //
                       (1000 * tf + 20 * (50 + (50 * len(ts) * n_docs) // n_terms)))) AS BIGINT) AS score
                FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN d USING (r), totals
                GROUP BY i, item_id, r),
     placed AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS k
                FROM scored JOIN d USING (r) WHERE score > 0)
SELECT item_id, CAST(k AS INTEGER) AS rank, doc_id, score FROM placed WHERE k <= 50
"""


@query
def op12_centroid_clusters(spark, sf):
    return centroids.cluster(table(spark, sf, "embeddings"), k=16, rounds=3)


def clusters_sql(k: int = 16, rounds: int = 3) -> str:
    """Every distance to every centroid in every round."""
    steps = [f"""
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
              FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64
                AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
     cells AS (SELECT r, unnest(v) AS x, unnest(range(1, 65)) AS i FROM kept),
     named AS (SELECT v, sha256('1:' || vec_id) AS h FROM kept ORDER BY h NULLS LAST, v LIMIT {k}),
     c0 AS (SELECT CAST(row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS INTEGER) AS c, v FROM named)"""]
    for n in range(rounds + 1):
        steps.append(f"""
     far{n} AS (SELECT r, c, CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2])
                           FOR p IN list_zip(kept.v, c{n}.v)]) AS BIGINT) AS d FROM kept, c{n}),
     near{n} AS (SELECT r, c, d FROM far{n} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if n < rounds:
            steps.append(f"""
     sums{n} AS (SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS m FROM near{n} JOIN cells USING (r) GROUP BY c, i),
     moved{n} AS (SELECT c, list((s - ((s % m) + m) % m) // m ORDER BY i) AS v FROM sums{n} GROUP BY c),
     c{n + 1} AS (SELECT c, coalesce(moved{n}.v, c{n}.v) AS v FROM c{n} LEFT JOIN moved{n} USING (c))""")
    return ",".join(steps) + f"""
SELECT vec_id, c AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM near{rounds} JOIN kept USING (r) JOIN c{rounds} USING (c)
"""


ORACLE["op12_centroid_clusters"] = clusters_sql()


@query
def op13_token_files(spark, sf):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as file:
        model = file.read()
    path = scratch_path(spark, "token-files")
    tokenfiles.write_token_files(table(spark, sf, "documents"), path, model, end_id=1)
    found = tokenfiles.read_token_files(spark, path)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def license_sql() -> str:
    """All runs of lines between two lines that share a word with a template, within the size bounds."""
    quoted = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in item))
                       for item in licenses.TEMPLATES.items())
    least = licenses.LEAST
    fold = r"regexp_replace(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
           r"'[^a-z0-9\x{{80}}-\x{{10FFFF}}\n]', ' ', 'g')"
    return rf"""
WITH templates(license, body) AS (VALUES {quoted}),
     wanted AS (SELECT license, regexp_extract_all({fold.format('body')}, '[^ \n]+') AS w FROM templates),
     vocabulary AS (SELECT DISTINCT license, unnest(w) AS word FROM wanted),
     grams AS (SELECT license, a, b, count(*) AS n FROM (
                 SELECT license, w[i] AS a, w[i + 1] AS b FROM wanted, unnest(range(1, len(w))) AS t(i)) GROUP BY ALL),
     sizes AS (SELECT license, len(w) - 1 AS size FROM wanted WHERE len(w) > 1),
     docs AS (SELECT row_number() OVER () AS r, doc_id, string_split({fold.format('text')}, chr(10)) AS lines
              FROM documents WHERE text IS NOT NULL),
     lines AS (SELECT r, i - 1 AS line, regexp_extract_all(lines[i], '[^ ]+') AS w
               FROM docs, unnest(range(1, len(lines) + 1)) AS t(i)),
     placed AS (SELECT *, coalesce(sum(len(w)) OVER (PARTITION BY r ORDER BY line
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lines),
     words AS (SELECT r, line, before + k AS p, w[k] AS word FROM placed, unnest(range(1, len(w) + 1)) AS t(k)),
     pairs AS (SELECT r, p, word AS a, lead(word) OVER (PARTITION BY r ORDER BY p) AS b FROM words),
     hits AS (SELECT r, license, p, a, b, n FROM pairs JOIN grams USING (a, b)),
     touched AS (SELECT DISTINCT r, license, line FROM words JOIN vocabulary USING (word)
                 WHERE (r, license) IN (SELECT DISTINCT r, license FROM hits)),
     ends AS (SELECT r, license, line, before, before + len(w) AS after FROM touched JOIN placed USING (r, line)),
     runs AS (SELECT f.r, f.license, f.line AS first_line, l.line AS last_line, f.before AS low, l.after AS high, size
              FROM ends f JOIN ends l ON f.r = l.r AND f.license = l.license AND f.line <= l.line
              JOIN sizes s ON s.license = f.license
              WHERE l.after - f.before - 1 BETWEEN size * {least}e0 / (2 - {least}e0) AND size * (2 - {least}e0) / {least}e0),
     shared AS (SELECT q.r, q.license, first_line, last_line, low, high, size, least(count(*), any_value(n)) AS s
                FROM runs q JOIN hits h ON h.r = q.r AND h.license = q.license AND h.p > low AND h.p < high
                GROUP BY q.r, q.license, first_line, last_line, low, high, size, a, b),
     scored AS (SELECT r, license, first_line, last_line, 2 * sum(s) / (any_value(high - low) - 1 + any_value(size)) AS dice
                FROM shared GROUP BY r, license, first_line, last_line)
SELECT doc_id, license, CAST(dice AS DOUBLE) AS dice, CAST(first_line AS BIGINT) AS first_line,
       CAST(last_line AS BIGINT) AS last_line
FROM scored JOIN docs USING (r) WHERE dice >= {least}e0
QUALIFY row_number() OVER (PARTITION BY r, license ORDER BY dice DESC, first_line, last_line) = 1
"""


ORACLE["op6_license_scan"] = license_sql()
