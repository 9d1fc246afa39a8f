"""SQL for the iterative vector operators: one step a round, on lists of whole numbers as doubles."""

from __future__ import annotations

from .clustering import CLUSTERS, DIMENSION, SALT
from .clustering import ROUNDS as CLUSTER_ROUNDS
from .clustering import SCALE as CLUSTER_SCALE
from .vector_codes import ENTRIES, PARTS
from .vector_codes import ROUNDS as CODE_ROUNDS
from .vector_codes import SCALE as CODE_SCALE

SOUND = """embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
GAP = "v.xx - 2 * list_inner_product(v.x, c.x) + c.xx"


def _whole(scale: int) -> str:
    return f"list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE)))"


def clustering_sql() -> str:
    steps = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, x, list_inner_product(x, x) AS xx FROM (
    SELECT vec_id, {_whole(CLUSTER_SCALE)} AS x FROM embeddings
    WHERE {SOUND} AND len(embedding) = {DIMENSION})
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, x, xx FROM (
    SELECT sha256('{SALT}' || CAST(vec_id AS VARCHAR)) AS h, x, xx FROM v ORDER BY h LIMIT {CLUSTERS})
)""",
    ]
    for n in range(CLUSTER_ROUNDS + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (
  SELECT v.vec_id, CAST(arg_min(c.c, ({GAP}) * {CLUSTERS} + c.c) AS INTEGER) AS c,
         CAST(min({GAP}) AS BIGINT) AS d FROM v, c{n} c GROUP BY v.vec_id
)"""
        )
        if n == CLUSTER_ROUNDS:
            break
        steps.append(
            f"""c{n + 1} AS MATERIALIZED (
  SELECT c, x, list_inner_product(x, x) AS xx FROM (
    SELECT o.c, coalesce(m.x, o.x) AS x FROM c{n} o LEFT JOIN (
      SELECT c, list(x ORDER BY i) AS x FROM (
        SELECT c, i, floor(sum(x) / count(*)) AS x FROM (
          SELECT a.c, unnest(range({DIMENSION})) AS i, unnest(v.x) AS x FROM a{n} a JOIN v USING (vec_id))
        GROUP BY c, i) GROUP BY c) m USING (c))
)"""
        )
    last = CLUSTER_ROUNDS
    return (
        "WITH "
        + ", ".join(steps)
        + f"""
SELECT a.vec_id, a.c AS cluster, a.d AS distance,
       CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c.x, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} c ON a.c = c.c
"""
    )


def vector_codes_sql() -> str:
    """For vectors of one length that the number of parts divides, as in the given tables."""
    steps = [
        f"""w AS MATERIALIZED (
  SELECT vec_id, label, x, len(x) // {PARTS} AS wide, p FROM (
    SELECT vec_id, label, {_whole(CODE_SCALE)} AS x, unnest(range({PARTS})) AS p
    FROM embeddings WHERE {SOUND})
), v AS MATERIALIZED (
  SELECT vec_id, p, x, list_inner_product(x, x) AS xx FROM (
    SELECT vec_id, p, x[p * wide + 1:(p + 1) * wide] AS x FROM w)
), c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS c, x, xx FROM v
  WHERE vec_id IN (SELECT DISTINCT vec_id FROM w ORDER BY vec_id LIMIT {ENTRIES})
)"""
    ]
    for n in range(CODE_ROUNDS + 1):
        steps.append(
            f"""a{n} AS MATERIALIZED (
  SELECT v.vec_id, v.p, arg_min(c.c, ({GAP}) * {ENTRIES} + c.c) AS c, CAST(min({GAP}) AS BIGINT) AS d
  FROM v JOIN c{n} c ON v.p = c.p GROUP BY v.vec_id, v.p
)"""
        )
        if n == CODE_ROUNDS:
            break
        steps.append(
            f"""c{n + 1} AS MATERIALIZED (
  SELECT p, c, x, list_inner_product(x, x) AS xx FROM (
    SELECT o.p, o.c, coalesce(m.x, o.x) AS x FROM c{n} o LEFT JOIN (
      SELECT p, c, list(x ORDER BY i) AS x FROM (
        SELECT p, c, i, floor(sum(x) / count(*)) AS x FROM (
          SELECT a.p, a.c, unnest(range(len(v.x))) AS i, unnest(v.x) AS x FROM a{n} a JOIN v USING (vec_id, p))
        GROUP BY p, c, i) GROUP BY p, c) m USING (p, c))
)"""
        )
    last = CODE_ROUNDS
    return (
        "WITH "
        + ", ".join(steps)
        + f""", coded AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(c AS INTEGER)), '' ORDER BY p) AS code,
         CAST(sum(d) AS BIGINT) AS error FROM a{last} GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(said, ',' ORDER BY p, c)) AS codebooks_sha256 FROM (
    SELECT p, c, array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ',') AS said FROM c{last})
)
SELECT k.vec_id, k.code, k.error, CAST(sum(k.error) OVER (PARTITION BY e.label) AS BIGINT) AS label_error,
       b.codebooks_sha256
FROM coded k JOIN embeddings e USING (vec_id), books b
"""
    )
