"""DuckDB versions of the operators that SQL can express."""

from __future__ import annotations

_DIGEST = "sha1(coalesce(html, ''))"
_FIVE_BYTES = [f"('0x' || substr({_DIGEST}, {1 + 10 * i}, 10))::BIGINT" for i in range(4)]
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (({n} >> {s}) & 31)::INT, 1)" for n in _FIVE_BYTES for s in range(35, -1, -5))

OP11 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, {_BASE32} AS payload_digest, coalesce(html, '') AS html FROM pages),
o AS (SELECT html, min(page_id) AS owner FROM p GROUP BY html)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM p JOIN o USING (html)
"""

_FINITE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

OP12 = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND {_FINITE}),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM kept a JOIN kept c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
pos AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, CAST(row_number() OVER w AS INT) AS rank, n.id AS negative_id,
       p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER w <= 10
"""


def _op13(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    sql = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE {_FINITE}),
x AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(v) // {parts}) AS part, (i - 1) % (len(v) // {parts}) AS pos, v[i] AS val
  FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM kept)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {entries}),
b0 AS MATERIALIZED (SELECT part, entry, pos, val FROM x JOIN first USING (vec_id))"""
    for k in range(rounds + 1):
        sql += f""",
a{k} AS MATERIALIZED (
  SELECT vec_id, part, min(d * {entries} + entry) % {entries} AS entry, min(d * {entries} + entry) // {entries} AS d FROM (
    SELECT x.vec_id, x.part, b.entry, CAST(sum((x.val - b.val) * (x.val - b.val)) AS BIGINT) AS d
    FROM x JOIN b{k} b ON x.part = b.part AND x.pos = b.pos GROUP BY ALL) GROUP BY vec_id, part)"""
        if k < rounds:
            sql += f""",
s{k} AS (SELECT a.part, a.entry, x.pos, CAST(sum(x.val) AS BIGINT) AS s, count(*) AS n FROM a{k} a JOIN x ON x.vec_id = a.vec_id AND x.part = a.part GROUP BY ALL),
b{k + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, CASE WHEN n IS NULL THEN b.val ELSE CAST((s - (((s % n) + n) % n)) // n AS BIGINT) END AS val
  FROM b{k} b LEFT JOIN s{k} s ON b.part = s.part AND b.entry = s.entry AND b.pos = s.pos)"""
    return sql + f""",
coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INT)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(val AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


OP13 = _op13()
