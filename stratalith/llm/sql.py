"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations


def sort_means_sql(k: int = 40, rounds: int = 5, seed: int = 2, d: int = 64, scale: int = 256) -> str:
    """Plain k-means in integers: every vector against every centroid, each round unrolled."""
    steps = [
        f"""q AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE len(embedding) = {d} AND len(list_filter(embedding, lambda x: isfinite(CAST(x AS DOUBLE)))) = {d})""",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, v FROM (SELECT sha256('{seed}:' || vec_id) AS h, v FROM q ORDER BY h LIMIT {k}))",
    ]
    for i in range(rounds + 1):
        far = f"list_sum(list_transform(range(1, {d + 1}), lambda i: (q.v[i] - c.v[i]) * (q.v[i] - c.v[i])))"
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, v, m.c AS c, CAST(m.d AS BIGINT) AS d FROM (SELECT r, any_value(q.vec_id) AS vec_id, any_value(q.v) AS v, min({{'d': {far}, 'c': c}}) AS m FROM q, c{i} c GROUP BY r))")
        if i < rounds:
            steps.append(
                f"""c{i + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.v, o.v) AS v FROM c{i} o LEFT JOIN (SELECT c, list(f ORDER BY p) AS v FROM
 (SELECT c, p, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f FROM (SELECT c, p, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM a{i}) GROUP BY c, p)) GROUP BY c) m ON m.c = o.c)"""
            )
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} z ON z.c = a.c"""


HARD_NEGATIVES = """WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
 WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: isfinite(CAST(x AS DOUBLE)))) = len(embedding)),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, 65), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score FROM e a, e b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS INTEGER) AS rank, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score QUALIFY rank <= 5"""
