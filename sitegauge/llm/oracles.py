"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: The table of crc32 as a list, and the checksum of a decimal number by it (``tab.l`` must be in scope).
_TABLE = "tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY i) AS l FROM range(256) AS r(i))"


def _crc(number: str) -> str:
    step = "lambda c, b: xor(c // 256, tab.l[CAST(xor(c % 256, b) AS INT) + 1])"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST({number} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), {step}), 4294967295)"


def _tree(name: str, leaves: str) -> str:
    """``name(level, g, i, n, digest, l, r)``: all nodes over ``leaves(level, g, i, n, digest)`` with the siblings on either side."""
    beside = lambda frame: f"coalesce(string_agg(digest, '') OVER (PARTITION BY level, g, i // 8 ORDER BY i ROWS BETWEEN {frame}), '')"
    grown = f"SELECT level + 1, g, i // 8, CAST(ceil(n / 8) AS BIGINT), sha256(string_agg(digest, '' ORDER BY i)) FROM {name}_n WHERE n > 1 GROUP BY level, g, i // 8, n"
    return f"{name}_n AS ({leaves} UNION ALL {grown}), {name} AS (SELECT *, {beside('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l, {beside('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name}_n)"


def _field(value: str) -> str:
    return f"(CASE WHEN {value} IS NULL THEN '-' ELSE concat(strlen(CAST({value} AS VARCHAR)), ':', {value}) END)"


_FACTS = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_SMALL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MERKLE = f"""WITH RECURSIVE {_TABLE},
 d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS g, sha256({_FACTS} || {_field('text')}) AS leaf, CASE WHEN {_crc('doc_id')} % 3 = 0 THEN sha256({_FACTS} || {_field(_SMALL)}) END AS bad FROM documents, tab),
 p AS (SELECT *, row_number() OVER w - 1 AS i, COUNT(*) OVER (PARTITION BY g) AS n FROM d WINDOW w AS (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf)),
 {_tree('a', 'SELECT 0 AS level, g, i, n, leaf AS digest FROM p')}, s AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY g) - 1 AS j, COUNT(*) OVER () AS m FROM a_n WHERE n = 1),
 {_tree('b', "SELECT 0 AS level, '' AS g, j AS i, m AS n, subroot AS digest FROM s")},
 steps AS (SELECT p.g, p.i, a.level AS k, l, r FROM p JOIN a ON a.g = p.g AND a.n > 1 AND a.i = p.i // CAST(pow(8, a.level) AS BIGINT) UNION ALL SELECT p.g, p.i, 100 + b.level, l, r FROM p JOIN s ON s.g = p.g JOIN b ON b.n > 1 AND b.i = s.j // CAST(pow(8, b.level) AS BIGINT)),
 o AS (SELECT *, row_number() OVER (PARTITION BY g, i ORDER BY k) AS step FROM steps), proof AS (SELECT g, i, string_agg(l || r, '' ORDER BY step) AS t FROM o GROUP BY g, i),
 f AS (SELECT g, i, CAST(0 AS BIGINT) AS step, coalesce(bad, leaf) AS digest FROM p UNION ALL SELECT f.g, f.i, o.step, sha256(o.l || f.digest || o.r) FROM f JOIN o ON o.g = f.g AND o.i = f.i AND o.step = f.step + 1),
 e AS (SELECT g, i, arg_max(digest, step) AS folded_root FROM f GROUP BY g, i), root AS (SELECT digest AS root FROM b_n WHERE n = 1)
 SELECT doc_id, leaf, subroot, root, sha256(coalesce(t, '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM p JOIN s USING (g) JOIN e ON e.g = p.g AND e.i = p.i LEFT JOIN proof ON proof.g = p.g AND proof.i = p.i, root"""

TRIE = f"""WITH {_TABLE},
 t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS d FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, MAX(d) AS n FROM t GROUP BY conv_id), h AS (SELECT conv_id, n, conv_id - conv_id % 20 AS base, {_crc('conv_id')} % 4 AS h FROM c, tab),
 k AS (SELECT h.*, least(h.h, coalesce(c.n, 0)) AS k FROM h LEFT JOIN c ON c.conv_id = h.base),
 r AS (SELECT t.conv_id, t.d - h + k AS d, role, text FROM t JOIN k ON k.conv_id = t.conv_id WHERE t.d > h UNION ALL SELECT k.conv_id, t.d, role, text FROM k JOIN t ON t.conv_id = k.base AND t.d <= k.k),
 x AS (SELECT conv_id, d, md5(string_agg(sha256(concat(strlen(role), ':', role, text)), '') OVER (PARTITION BY conv_id ORDER BY d)) AS key, len(regexp_extract_all(text, '[^ \\t-\\r]+')) AS words, d = MAX(d) OVER (PARTITION BY conv_id) AS final FROM r),
 y AS (SELECT conv_id, d, key, words, final FROM x UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM x) FROM c),
 v AS (SELECT d, key, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, MAX(words) AS words, count_if(final) = COUNT(*) AS leaf, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (final), '') AS ends FROM y GROUP BY d, key),
 below AS (SELECT y.d, y.key, SUM(CASE WHEN v.leaf THEN 1 ELSE 0 END) AS n_leaves, SUM((v.n_convs - 1) * v.words) AS saved, count_if(v.d = y.d + 1) AS n_children FROM v JOIN y ON y.conv_id = v.conv_id AND y.d <= v.d GROUP BY y.d, y.key)
 SELECT v.conv_id, v.d AS depth, u.conv_id AS parent_conv_id, v.n_convs, CAST(n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(v.ends) AS ends_sha256
 FROM v JOIN below USING (d, key) LEFT JOIN y ON y.conv_id = v.conv_id AND y.d = v.d - 1 LEFT JOIN v u ON u.d = y.d AND u.key = y.key"""

_DOT = lambda a, b: f"list_reduce(list_transform(list_zip({a}, {b}), lambda t: CAST(t[1] AS DOUBLE) * CAST(t[2] AS DOUBLE)), lambda x, y: x + y)"
#: Exact neighbours by all pairs. A row of the query is a bounded share of the table, in blocks of queries at any size.
NEAREST = f"""WITH e AS (SELECT vec_id, embedding AS v, sqrt({_DOT('embedding', 'embedding')}) AS n FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL), u AS (SELECT * FROM e WHERE n > 0 AND isfinite(n)),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, {_DOT('c.v', 'q.v')} / (c.n * q.n) AS score FROM u q JOIN u c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
 SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""

SQL = {"op6_learned_partitions": NEAREST, "op11_prefix_trie": TRIE, "op13_merkle": MERKLE}
