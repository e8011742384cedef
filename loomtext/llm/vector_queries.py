"""Queries over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame

from loomtext.llm.centroids import cluster_vectors
from loomtext.llm.registry import query
from loomtext.llm.whitening import whiten
from loomtext.suite import Tables

_ROUNDS = 5


def _assigned(k: int) -> str:
    return f"""
    a{k} AS MATERIALIZED (
      SELECT rid, arg_min(num, (d, num)) AS num, min(d) AS d FROM (
        SELECT rid, num, sum((x - c) * (x - c))::BIGINT AS d FROM entries JOIN c{k} USING (dim)
        GROUP BY rid, num) GROUP BY rid)"""


def _moved(k: int) -> str:
    return f"""
    c{k + 1} AS MATERIALIZED (
      SELECT num, dim, coalesce(m, c) AS c FROM c{k} LEFT JOIN (
        SELECT num, dim, floor(sum(x)::DOUBLE / count(*))::BIGINT AS m
        FROM entries JOIN a{k} USING (rid) GROUP BY num, dim) USING (num, dim))"""


CENTROIDS = f"""
    WITH kept AS MATERIALIZED (
      SELECT vec_id, row_number() OVER () AS rid, v, row_number() OVER (
               ORDER BY sha256('2:' || vec_id::VARCHAR), v) - 1 AS num
      FROM (SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding,
              lambda e: e IS NULL OR NOT isfinite(e::DOUBLE))) = 0)),
    entries AS MATERIALIZED (
      SELECT rid, num AS n, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM kept),
    c0 AS MATERIALIZED (SELECT n::INTEGER AS num, dim, x AS c FROM entries WHERE n < 40),
    {", ".join(_assigned(k) + "," + _moved(k) for k in range(_ROUNDS))},
    {_assigned(_ROUNDS)},
    digests AS (
      SELECT num, sha256(string_agg(c::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256
      FROM c{_ROUNDS} GROUP BY num)
    SELECT vec_id, num AS cluster, d AS distance,
           (sum(d) OVER (PARTITION BY num))::BIGINT AS cluster_inertia,
           (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
    FROM a{_ROUNDS} JOIN kept USING (rid) JOIN digests USING (num)
""".replace("JOIN kept USING (rid)", "JOIN (SELECT rid, vec_id FROM kept) USING (rid)")


@query("op12_centroid_clustering", CENTROIDS)
def op12_centroid_clustering(tables: Tables) -> DataFrame:
    return cluster_vectors(tables.embeddings)


@query("op13_embedding_whitening")
def op13_embedding_whitening(tables: Tables) -> DataFrame:
    return whiten(tables.embeddings)
