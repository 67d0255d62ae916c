"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import clustering, fingerprints, hamming, jaccard, licenses, mixing, packing, quality, sharding, toxicity, tries, warc, whitening
from .common import read


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"))


def op2_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(read(spark, sf_dir, "documents"))


def op6_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest(read(spark, sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(read(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, read(spark, sf_dir, "labels")))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.deduplicate(read(spark, sf_dir, "documents"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_source_mixing, op2_lpt_sharding, op3_toxicity, op4_ngram_jaccard, op5_imatch_fingerprints, op6_hamming_topk, op7_warc, op8_quality, op9_license_scan, op10_packing, op11_whitening, op12_exact_dedup, op13_centroid_clusters)}


_OP4 = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM words),
sets AS (SELECT doc_id, list_distinct(g) AS g FROM runs),
elements AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM elements a JOIN elements b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, (SELECT min(other) FROM reach r WHERE r.doc_id = s.doc_id) AS component_id FROM sets s"""

_OP6 = """WITH pairs AS (SELECT q.vec_id AS query_id, v.vec_id AS neighbor_id,
  CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN coalesce(q.embedding[i] > 0, false) <> coalesce(v.embedding[i] > 0, false) THEN 1 ELSE 0 END)) AS BIGINT) AS distance
  FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INT) AS rank FROM pairs)
SELECT query_id, neighbor_id, distance, rank FROM ranked WHERE rank <= 10"""


_OP12 = """WITH texts AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM texts GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, g.text_sha256 FROM texts d JOIN groups g ON g.t = d.t"""


def _op13() -> str:
    """Rounds of clustering one after another: assign every vector to its nearest centroid, move the centroids."""

    def nearest(c: str) -> str:
        apart = f"list_sum(list_transform(range(1, {clustering.DIMS + 1}), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))"
        return f"SELECT k.n, min((CAST({apart} AS BIGINT), c.c)) AS best FROM kept k, {c} c GROUP BY k.n"

    steps = [
        f"sized AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = {clustering.DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {clustering.DIMS})",
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor({clustering.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM sized)",
        f"c0 AS MATERIALIZED (SELECT CAST(place - 1 AS INT) AS c, v FROM (SELECT v, row_number() OVER (ORDER BY sha256('{clustering.SEED}:' || CAST(vec_id AS VARCHAR)), v) AS place FROM kept) WHERE place <= {clustering.K})",
    ]
    for r in range(clustering.ROUNDS):
        steps += [
            f"a{r} AS MATERIALIZED ({nearest(f'c{r}')})",
            f"s{r} AS (SELECT best[2] AS c, i, sum(k.v[i]) AS s, count(*) AS m FROM a{r} JOIN kept k USING (n), range(1, {clustering.DIMS + 1}) t(i) GROUP BY best[2], i)",
            f"m{r} AS (SELECT c, list(CAST((s - ((s % m) + m) % m) // m AS BIGINT) ORDER BY i) AS v FROM s{r} GROUP BY c)",
            f"c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m ON m.c = c.c)",
        ]
    last = f"c{clustering.ROUNDS}"
    steps += [
        f"ended AS MATERIALIZED (SELECT n, best[1] AS distance, best[2] AS cluster FROM ({nearest(last)}))",
        "sums AS (SELECT cluster, CAST(sum(distance) AS BIGINT) AS cluster_inertia FROM ended GROUP BY cluster)",
        f"names AS (SELECT c, sha256(array_to_string(list_transform(v, lambda x: CAST(x AS VARCHAR)), ',')) AS centroid_sha256 FROM {last})",
    ]
    return f"""WITH {", ".join(steps)}
SELECT k.vec_id, CAST(e.cluster AS INT) AS cluster, e.distance, s.cluster_inertia, CAST((SELECT sum(distance) FROM ended) AS BIGINT) AS inertia, names.centroid_sha256
FROM ended e JOIN kept k USING (n) JOIN sums s USING (cluster) JOIN names ON names.c = e.cluster"""


def oracle_sql() -> dict[str, str]:
    """The others learn a model, hash, tokenize or schedule as SQL cannot; their tests hold them
    against brute force, round trips or held-out labels."""
    return {"op4_ngram_jaccard": _OP4, "op6_hamming_topk": _OP6, "op12_exact_dedup": _OP12, "op13_centroid_clusters": _op13()}
