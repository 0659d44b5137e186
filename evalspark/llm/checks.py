"""SQL forms of the operators that SQL can express, for DuckDB."""

from __future__ import annotations


def lloyd_sql(dims: int = 64, k: int = 40, rounds: int = 5, salt: str = "2:") -> str:
    """Vectors and centroids in long form; every round is a pair of common table expressions."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT rn, k, d FROM (
    SELECT rn, k, d, row_number() OVER (PARTITION BY rn ORDER BY d, k) AS nth FROM (
      SELECT v.rn, c.k, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{r} c ON v.dim = c.dim GROUP BY v.rn, c.k)) WHERE nth = 1)""")
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c.k, c.dim, CAST(coalesce((s - ((s % n) + n) % n) // n, c.x) AS BIGINT) AS x
    FROM c{r} c LEFT JOIN (SELECT a.k, v.dim, sum(v.x) AS s, count(*) AS n FROM a{r} a JOIN v ON a.rn = v.rn GROUP BY a.k, v.dim) m
    ON c.k = m.k AND c.dim = m.dim)""")
    return f"""WITH held AS MATERIALIZED (
    SELECT row_number() OVER () AS rn, vec_id,
      list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS cells FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
  v AS MATERIALIZED (SELECT rn, unnest(range({dims})) AS dim, unnest(cells) AS x FROM held),
  heads AS (SELECT row_number() OVER (ORDER BY digest, cells) - 1 AS k, cells FROM (
    SELECT sha256('{salt}' || coalesce(CAST(vec_id AS VARCHAR), '')) AS digest, cells FROM held ORDER BY digest, cells LIMIT {k})),
  c0 AS MATERIALIZED (SELECT k, unnest(range({dims})) AS dim, unnest(cells) AS x FROM heads),
  {", ".join(steps)},
  names AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY k)
SELECT held.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM a{rounds} a JOIN held ON a.rn = held.rn JOIN names ON a.k = names.k"""


# one step of eight per character; the polynomial is that of the usual crc32
CRC32 = """xor(4294967295, list_reduce(
      flatten(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
        lambda i: [CAST(ascii(substr(CAST(conv_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
      lambda s, x: xor(xor(s, x) >> 1, 3988292384 * (xor(s, x) & 1)), CAST(4294967295 AS BIGINT)))"""

TRIE_SQL = f"""WITH t AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
  own AS MATERIALIZED (
    SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text) AS l FROM t GROUP BY conv_id),
  c AS MATERIALIZED (SELECT conv_id, l, conv_id - ((conv_id % 20) + 20) % 20 AS base, {CRC32} % 4 AS h FROM own),
  rebuilt AS MATERIALIZED (
    SELECT c.conv_id, list_concat(list_slice(b.l, 1, c.h), list_slice(c.l, c.h + 1, len(c.l))) AS l
    FROM c LEFT JOIN own b ON b.conv_id = c.base),
  members AS (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS depth FROM rebuilt),
  nodes AS MATERIALIZED (
    SELECT list_slice(l, 1, depth) AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
      string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(l) = depth) AS ids
    FROM members GROUP BY ALL),
  kids AS (SELECT list_slice(p, 1, depth - 1) AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
  valued AS MATERIALIZED (
    SELECT nodes.*, coalesce(kids.n, 0) AS n_children, CASE WHEN nodes.depth = 0 THEN 0 ELSE
      (n_convs - 1) * len(regexp_extract_all(nodes.p[nodes.depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
    FROM nodes LEFT JOIN kids ON nodes.p = kids.p),
  ups AS (SELECT p, n_children, saved, unnest(range(0, depth + 1)) AS a FROM valued),
  sums AS (SELECT list_slice(p, 1, a) AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM ups GROUP BY list_slice(p, 1, a))
SELECT x.conv_id, x.depth, up.conv_id AS parent_conv_id, x.n_convs, x.n_children, sums.n_leaves,
  CAST(sums.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(x.ids, '')) AS ends_sha256
FROM valued x JOIN sums ON x.p = sums.p LEFT JOIN nodes up ON x.depth > 0 AND up.p = list_slice(x.p, 1, x.depth - 1)"""

CHECKS = {"op11_lloyd_clusters": lloyd_sql(), "op13_conversation_trie": TRIE_SQL}
