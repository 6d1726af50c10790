"""The registered queries of this subpackage: thin layers over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import classes

    return classes(read_table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(read_table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import top_k

    table = read_table(spark, sf_dir, "embeddings")
    return top_k(table, table.where("vec_id % 50 = 0"), 5)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""


def op4_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import encode

    return encode(read_table(spark, sf_dir, "documents"), keep_ids=False)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import scored

    return scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    return archived(read_table(spark, sf_dir, "pages"))


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
SELECT page_id, n::BIGINT AS payload_bytes,
  list_reduce(list_transform([0,1,2,3,4,5,6,7], lambda g: list_reduce(list_transform([15,10,5,0], lambda b:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * g, 5))::BIGINT >> b) & 31)::INT, 1)), lambda x, y: x || y)), lambda x, y: x || y) AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM m"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import findings

    return findings(read_table(spark, sf_dir, "documents"))


def op8_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import placed

    rows = placed(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "virtual_slot", "balanced_shard")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import scored

    return scored(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import overlaps

    return overlaps(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .annulus import clustered

    return clustered(read_table(spark, sf_dir, "embeddings"))


def _op11_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """Every round as plain SQL over all pairs of a vector and a centroid."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), q) - 1 AS k, q FROM v QUALIFY k < {k})",
    ]
    for r in range(rounds + 1):
        pairs = f"SELECT row, vec_id, v.q, k, list_sum(list_transform(range(1, {dim + 1}), lambda i: (v.q[i] - c.q[i]) * (v.q[i] - c.q[i])))::BIGINT AS d FROM v, c{r} AS c"
        parts.append(f"a{r} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(q) AS q, min(k) AS cluster, min(d) AS distance FROM (SELECT *, min(d) OVER (PARTITION BY row) AS least FROM ({pairs})) WHERE d = least GROUP BY row)")
        if r < rounds:
            sums = f"SELECT cluster, i, sum(x) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, unnest(range(1, {dim + 1})) AS i FROM a{r}) GROUP BY cluster, i"
            moved = f"SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS q FROM ({sums}) GROUP BY cluster"
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m.q, c.q) AS q FROM c{r} AS c LEFT JOIN ({moved}) AS m ON m.cluster = c.k)")
    return f"""WITH {", ".join(parts)}
SELECT vec_id, cluster::INT AS cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} AS c ON c.k = cluster"""


def op12_lanczos_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whitened

    return whitened(read_table(spark, sf_dir, "embeddings"))


def op13_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .permutation_index import nearest

    table = read_table(spark, sf_dir, "embeddings")
    return nearest(table, table.where("vec_id % 100 = 0"), 10)


QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_token_counts, op3_exact_topk, op4_bpe_codec, op5_toxicity, op6_warc, op7_pii, op8_virtual_slots, op9_quality, op10_decontamination, op11_annulus_clusters, op12_lanczos_whitening, op13_permutation_index)}
ORACLES: dict[str, str] = {"op3_exact_topk": OP3_SQL, "op6_warc": OP6_SQL, "op11_annulus_clusters": _op11_sql()}
