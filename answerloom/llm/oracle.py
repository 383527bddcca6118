"""SQL for another engine, to compare the join, clustering and trie queries with."""

from __future__ import annotations

_LOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

# Sets as sorted lists of shingles; equal ones are one node, named by the least document. Nodes that share a shingle are compared.
JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOW}), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i : i + 3], ' ')) END)) AS shingles FROM w
), node AS (SELECT shingles, min(doc_id) AS node, len(shingles) AS n FROM s WHERE len(shingles) > 0 GROUP BY shingles),
post AS (SELECT node, n, unnest(shingles) AS shingle FROM node),
shared AS (SELECT p.node AS a, q.node AS b, p.n + q.n AS both_sizes, count(*) AS common FROM post p JOIN post q USING (shingle) WHERE p.node <> q.node GROUP BY ALL),
link AS (SELECT a, b FROM shared WHERE 100 * common >= 85 * (both_sizes - common)),
reached AS (SELECT node AS a, node AS b FROM node UNION SELECT r.a, l.b FROM reached r JOIN link l ON r.b = l.a),
component AS (SELECT a AS node, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM s LEFT JOIN node USING (shingles) LEFT JOIN component USING (node)
"""


def clustering(dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: int = 2) -> str:
    """Rounds written out one after the other; floor of a quotient of whole numbers by its remainder."""
    distance = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))"
    steps = [
        f"v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        f"WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS c, v FROM v QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT vec_id, any_value(x.v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT x.vec_id, x.v, c.c, {distance} AS d FROM v x, c{r} c) x GROUP BY vec_id)")
        if r < rounds:
            steps.append(f"t{r} AS (SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) g(i) GROUP BY c, i)")
            steps.append(f"m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM t{r} GROUP BY c)")
            steps.append(f"c{r + 1} AS (SELECT c, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} m USING (c))")
    return f"""
WITH {", ".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(e.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} e USING (c)
"""


# CRC-32 by its bits; a path has 33 characters a turn, so a parent's path is a prefix of its child's.
TRIE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', role, text))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: CAST(i AS BIGINT))),
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, CAST(3988292384 AS BIGINT)) ELSE x // 2 END)), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS part, b.pos, b.role, b.text FROM c JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 20 AND b.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h
), s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, md5(concat(length(role), ':', role, text)) || ' ' AS h,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM r
), p AS (
  SELECT conv_id, d, w, string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM s
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), n AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w FROM p GROUP BY path, d),
e AS (SELECT path, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends FROM (SELECT conv_id, arg_max(path, d) AS path FROM p GROUP BY conv_id) GROUP BY path),
k AS (SELECT left(path, CAST((d - 1) * 33 AS BIGINT)) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
u AS (
  SELECT left(path, CAST(up * 33 AS BIGINT)) AS path, sum((n_convs - 1) * w) AS saved, count(*) FILTER (WHERE n_children IS NULL) AS leaves
  FROM (SELECT n.*, n_children, unnest(range(0, d + 1)) AS up FROM n LEFT JOIN k USING (path)) GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves,
  CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM n JOIN u USING (path) LEFT JOIN k USING (path) LEFT JOIN e USING (path)
LEFT JOIN n m ON n.d > 0 AND m.path = left(n.path, CAST((n.d - 1) * 33 AS BIGINT))
"""
