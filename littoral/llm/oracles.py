"""DuckDB SQL for the operators whose results SQL can express, by plain definition and not by the operators' methods."""

from __future__ import annotations

from . import line_dedup

WORDS = r"list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda w: w <> '')"



def crc32(text: str) -> str:
    """CRC-32 of ASCII text: each byte is added to the state, then eight bits are shifted out (-1: one bit)."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    state = f"list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, (s & 1) * 3988292384) END)"
    return f"xor({state}, 4294967295)"


SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 34), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
repeated AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS i FROM windows SEMI JOIN repeated USING (s)),
kept AS (
  SELECT x.doc_id, count(gone.i) AS n_removed, string_agg(x.word, ' ' ORDER BY x.i) FILTER (WHERE gone.i IS NULL) AS kept
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d) x
  LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i GROUP BY x.doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

JACCARD_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (sh) WHERE x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n AS p ON p.doc_id = a JOIN n AS q ON q.doc_id = b WHERE c >= 0.8 * (p.n + q.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r),
classes AS (SELECT doc_id, min(r) AS class_id FROM reach GROUP BY doc_id),
counts AS (SELECT a AS doc_id, count(*) AS k FROM links GROUP BY a)
SELECT doc_id, class_id, coalesce(k, 0) AS n_links FROM classes LEFT JOIN counts USING (doc_id)
"""

EXACT_TOPK = """
WITH v AS (
  SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

#: Windows as strings, met by equality.
DECONTAMINATION = r"""
WITH words AS (
  SELECT 'd' AS side, doc_id::VARCHAR AS id, text FROM documents UNION ALL SELECT 'i', item_id::VARCHAR, text FROM benchmark),
t AS (
  SELECT side, id, coalesce(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> ''), []) AS w
  FROM words),
lengths AS (SELECT DISTINCT least(len(w), 10) AS n FROM t WHERE side = 'i' AND len(w) > 0),
windows AS (
  SELECT side, id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT side, id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM t JOIN lengths ON CASE WHEN side = 'i' THEN n = least(len(w), 10) ELSE n <= len(w) END)),
item AS (SELECT DISTINCT id AS item, n, s FROM windows WHERE side = 'i'),
met AS (SELECT id, i, n, item FROM (SELECT * FROM windows WHERE side = 'd') JOIN item USING (n, s)),
hit AS (SELECT id, count(*) AS n_hit FROM (SELECT DISTINCT id, unnest(range(i, i + n)) AS at FROM met) GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT id, item FROM met) GROUP BY id)
SELECT id::BIGINT AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items.s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM t LEFT JOIN hit USING (id) LEFT JOIN items USING (id) WHERE side = 'd'
"""

#: Nodes as lists of turns.
PREFIX_TRIE = f"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT conv_id AS c, {crc32('conv_id::VARCHAR')} % 6 AS h FROM (SELECT DISTINCT conv_id FROM o)),
b AS (
  SELECT c, i, role, text FROM m JOIN o ON o.conv_id = c - c % 100 AND i < h
  UNION ALL SELECT c, i, role, text FROM m JOIN o ON o.conv_id = c AND i >= h),
s AS (SELECT c, coalesce(list({{'role': role, 'text': text}} ORDER BY i) FILTER (WHERE i IS NOT NULL), []) AS seq FROM m LEFT JOIN b USING (c) GROUP BY c),
p AS (SELECT c, seq, d, list_slice(seq, 1, d) AS node FROM (SELECT c, seq, unnest(range(0, len(seq) + 1)) AS d FROM s)),
n AS (
  SELECT node, d, min(c) AS conv_id, count(*) AS n_convs, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE len(seq) = d) AS ends
  FROM p GROUP BY node, d),
k AS (SELECT list_slice(node, 1, d - 1) AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * length(node[d].text) ELSE 0 END AS saved FROM n LEFT JOIN k USING (node)),
sums AS (
  SELECT list_slice(node, 1, a) AS node, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM own) GROUP BY 1)
SELECT own.conv_id, own.d AS depth, up.conv_id AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, sha256(coalesce(own.ends, '')) AS ends_sha256
FROM own JOIN sums USING (node) LEFT JOIN n AS up ON own.d > 0 AND up.node = list_slice(own.node, 1, own.d - 1)
"""

#: Every pair of equal words at most a third of a document apart, in gaps and islands for each distance.
PERIODIC_RUNS = f"""
WITH t AS (SELECT doc_id, coalesce({WORDS}, []) AS w, {crc32('doc_id::VARCHAR')} AS h FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
d AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE
    list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) END AS w
  FROM a),
x AS (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
pairs AS (SELECT l.doc_id, r.i - l.i AS p, l.i FROM x l JOIN x r ON l.doc_id = r.doc_id AND l.word = r.word AND r.i > l.i AND 3 * (r.i - l.i) <= l.n),
islands AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM pairs),
runs AS (
  SELECT doc_id, start, length, min(p) AS period
  FROM (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM islands GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(24, 3 * p))
  GROUP BY doc_id, start, length),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS s FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS s FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(listed.s, '')) AS runs_sha256, sha256(coalesce(kept.s, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL = {
    "op5_substring_dedup": SUBSTRING_DEDUP,
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op8_ngram_jaccard_join": JACCARD_JOIN,
    "op10_mtree_topk": EXACT_TOPK,
    "op11_decontamination": DECONTAMINATION,
    "op12_prefix_trie": PREFIX_TRIE,
    "op13_periodic_runs": PERIODIC_RUNS,
}
