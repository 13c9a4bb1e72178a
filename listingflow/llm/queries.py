"""The registered queries of the training-data operators, one for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingflow.llm.centroids import cluster_vectors
from listingflow.llm.common import table
from listingflow.llm.hard_negatives import hard_negatives
from listingflow.llm.html_extract import extract_pages
from listingflow.llm.lm_scoring import score_texts
from listingflow.llm.mixing import mix
from listingflow.llm.packing import pack
from listingflow.llm.quality_rules import DecisionList, fit_rules, judge_quality
from listingflow.llm.secret_scan import corpus_words, scan_secrets
from listingflow.llm.simhash import simhash_components
from listingflow.llm.token_counts import count_tokens
from listingflow.llm.topk import top_k
from listingflow.llm.toxicity import fit_toxicity, score_toxicity
from listingflow.llm.url_filters import judge_urls

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pack(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = count_tokens(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS rules(host, path, verdict)")
    got = judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return got.select("page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, words=tuple(corpus_words(docs))).drop("found")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents"))
    return got.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rules = fit_rules(docs, table(spark, sf_dir, "labels"))
    s = "quality_stats"
    got = judge_quality(docs.select("doc_id", "text"), rules)
    return got.select("doc_id", *[f"{s}.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cluster_vectors(table(spark, sf_dir, "embeddings"))
    return got.withColumn("centroid_sha256", F.sha2(F.concat_ws(",", F.col("centroid").cast("array<string>")), 256)).drop("centroid")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out))
    got = score_toxicity(docs, model)
    return got.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


# what SQL can say of operators whose method it can't express


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(table(spark, sf_dir, "documents"))
    near = F.abs(F.sum(F.col("size") * F.size("draws")) - F.max("target")) <= F.greatest(0.01 * F.max("target"), F.max("size") / 2)
    return got.groupBy("source").agg(F.count("*").alias("n_docs"), F.max("source_size").alias("source_size"), F.floor(F.max("target") + 0.5).cast("long").alias("target"), near.alias("near"), (F.max(F.size("draws")) <= 3).alias("few"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judge_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), DecisionList(()))
    return got.select("doc_id", *[f"quality_stats.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")])


QUERIES = {f.__name__: f for f in (op1_html_extract, op2_packing, op3_token_counts, op4_url_filters, op5_secret_scan, op6_lm_scoring, op7_mixing, op8_simhash, op9_quality_rules, op10_top_k, op11_centroids, op12_hard_negatives, op13_toxicity, secret_counts, mix_targets, quality_base)}



def _centroids_sql() -> str:
    """The first centroids, five rounds and the last assignment, one after the other."""
    steps = [
        """v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, x AS c FROM (SELECT x, sha256('2:' || CAST(vec_id AS VARCHAR)) AS h FROM v ORDER BY h LIMIT 40))""",
    ]
    for n in range(6):
        steps.append(
            f"""a{n} AS MATERIALIZED (
  SELECT vec_id, x, min(struct_pack(d := d, c := cluster)) AS best FROM (
    SELECT vec_id, x, cluster, CAST(list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v, c{n}) GROUP BY vec_id, x)"""
        )
        if n < 5:
            steps.append(
                f"""m{n} AS MATERIALIZED (
  SELECT cluster, list(m ORDER BY dim) AS m FROM (
    SELECT best.c AS cluster, dim, CAST(floor(sum(x[dim])::DOUBLE / count(*)) AS BIGINT) AS m FROM a{n}, range(1, 65) AS r(dim) GROUP BY best.c, dim) GROUP BY cluster),
c{n + 1} AS MATERIALIZED (SELECT cluster, coalesce(m, c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster))"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, best.c AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a5 JOIN c5 ON best.c = c5.cluster"""


ORACLE = {
    "op4_url_filters": r"""
WITH rules(rhost, rpath, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM parts LEFT JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1""",
    "op10_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op11_centroids": _centroids_sql(),
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS alike, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score
  FROM v a JOIN v c ON c.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.alike AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
QUALIFY row_number() OVER w <= 3""",
    "secret_counts": r"""
SELECT doc_id,
  CAST(len(list_filter(regexp_extract_all(x, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda g: length(g) >= 12)) AS BIGINT) AS n_assign,
  CAST(len(list_filter(regexp_extract_all(x, 'AKIA[A-Z0-9]+'), lambda g: length(g) >= 18)) AS BIGINT) AS n_access,
  CAST(len(list_filter(regexp_extract_all(x, '[0-9a-f]+'), lambda g: length(g) >= 16)) AS BIGINT) AS n_hex
FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)""",
    "mix_targets": r"""
WITH s AS (
  SELECT source, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS size FROM documents GROUP BY source),
w AS (SELECT *, [1.0, 2.0, 3.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight FROM s),
c AS (
  SELECT *, 3.0 * size / weight AS cap, coalesce(sum(3.0 * size) OVER before, 0)::DOUBLE AS fixed, (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS open, sum(size) OVER () AS total
  FROM w WINDOW before AS (ORDER BY 3.0 * size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT (SELECT (total - fixed) / open FROM c WHERE (total - fixed) / open <= cap ORDER BY cap, source LIMIT 1) AS rate)
SELECT source, n_docs, size AS source_size, CAST(floor(least(3.0 * size, weight * coalesce(rate, 1e300))::DOUBLE + 0.5) AS BIGINT) AS target, true AS near, true AS few FROM w, r""",
    "quality_base": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
s AS (
  SELECT doc_id, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w, length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s)),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM t, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id),
a AS (
  SELECT s.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
  FROM s LEFT JOIN p USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a""",
}
