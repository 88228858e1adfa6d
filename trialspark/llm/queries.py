"""One query for each operator, over whole tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, fingerprint, html_extract, language_id, minhash_dedup, packing, pii, quality_ranker, quality_rules, sentencepiece_codec, sharding, toxicity, whitening
from .common import held_out, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_quality_ranker(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_ranker.score(docs, quality_ranker.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"), ["doc_id"])


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_components(table(spark, sf_dir, "documents"), minhash_dedup.Near(k=3, percent=85))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(table(spark, sf_dir, "documents"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"), ["doc_id"])


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    named = language_id.identify(docs, language_id.fit(docs), ["doc_id"])
    return named.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    ratio = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, ratio, keep=["doc_id"])


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


def op12_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.report(table(spark, sf_dir, "embeddings"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_sharding, op2_quality_ranker, op3_sentencepiece, op4_minhash_dedup, op5_packing, op6_toxicity, op7_fingerprint, op8_pii,
            op9_language_id, op10_quality_rules, op11_html_extract, op12_yinyang_clusters, op13_whitening,
        )
    }


#: All pairs by shared shingles, then the least id reachable. Documents of one set
#: come in as one node, so that copies don't multiply.
OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) END AS s
  FROM words
), nodes AS (
  SELECT s, min(doc_id) AS node, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), items AS (
  SELECT node, n, unnest(s) AS x FROM nodes
), pairs AS (
  SELECT a.node AS u, b.node AS v FROM items a JOIN items b ON a.x = b.x AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT u, v FROM pairs UNION ALL SELECT v, u FROM pairs
), reach AS (
  SELECT node AS origin, node AS place FROM nodes
  UNION
  SELECT r.origin, e.v FROM reach r JOIN both_ways e ON e.u = r.place
), roots AS (
  SELECT origin AS node, min(place) AS root FROM reach GROUP BY origin
)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(r.root, d.doc_id) AS component_id, d.doc_id = coalesce(r.root, d.doc_id) AS kept
FROM sets d LEFT JOIN nodes n ON n.s = d.s LEFT JOIN roots r ON r.node = n.node
"""


def op12_sql(k: int = 16, rounds: int = 3) -> str:
    """Plain rounds of nearest centroid and floor of the mean, one row a component."""
    steps = f"""
kept AS (
  SELECT vec_id, embedding FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = 64
), xs AS MATERIALIZED (
  SELECT vec_id, i, CAST(floor(64 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, 65) AS r(i)
), ranked AS (
  SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS cluster FROM (SELECT DISTINCT vec_id FROM kept) QUALIFY cluster < {k}
), c0 AS MATERIALIZED (
  SELECT cluster, i, x AS c FROM ranked JOIN xs USING (vec_id)
)"""
    for r in range(rounds + 1):
        steps += f""", a{r} AS MATERIALIZED (
  SELECT vec_id, CAST(arg_min(cluster, (d, cluster)) AS INTEGER) AS cluster, min(d) AS distance
  FROM (SELECT vec_id, cluster, CAST(sum((x - c) * (x - c)) AS BIGINT) AS d FROM xs JOIN c{r} USING (i) GROUP BY vec_id, cluster) GROUP BY vec_id
)"""
        if r < rounds:
            steps += f""", c{r + 1} AS MATERIALIZED (
  SELECT cluster, i, CASE WHEN m.n IS NULL THEN o.c ELSE (m.s - ((m.s % m.n) + m.n) % m.n) // m.n END AS c
  FROM c{r} o LEFT JOIN (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM xs JOIN a{r} USING (vec_id) GROUP BY cluster, i) m USING (cluster, i)
)"""
    return f"""WITH {steps}, marks AS (
  SELECT cluster, sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster
)
SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} JOIN marks USING (cluster)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_minhash_dedup": OP4_SQL, "op12_yinyang_clusters": op12_sql()}
