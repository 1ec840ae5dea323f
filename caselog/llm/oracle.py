"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Windows of 13 words, of benchmark items against all documents, by equal strings.
OP7 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bs AS (
  SELECT item_id, least(13, len(w)) AS n, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS pos FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS win FROM bs),
sizes AS (SELECT DISTINCT n FROM bw),
ds AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, sizes WHERE len(w) >= n),
hits AS (
  SELECT ds.doc_id, ds.pos, ds.n, bw.item_id FROM
    (SELECT doc_id, pos, n, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS win FROM ds) ds JOIN bw ON ds.win = bw.win AND ds.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hits) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Targets, streams in hash order, blocks, and the golden-ratio schedule in whole numbers.
OP9 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM s0),
s2 AS (
  SELECT *, 2 * source_size AS cap, ([3, 1, 2])[(no - 1) % 3 + 1] AS weight,
    CAST(coalesce(sum(source_size) OVER (ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM s1),
s3 AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5 AS total,
    CAST(coalesce(sum(cap) OVER r, 0) AS DOUBLE) AS cap_before, CAST(coalesce(sum(weight) OVER r, 0) AS DOUBLE) AS weight_before,
    CAST(sum(weight) OVER () AS DOUBLE) AS weights
  FROM s2 WINDOW r AS (ORDER BY CAST(cap AS DOUBLE) / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s4 AS (SELECT *, cap * (weights - weight_before) <= (total - cap_before) * weight AS capped FROM s3),
s5 AS (
  SELECT *, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE
    (total - coalesce(sum(CASE WHEN capped THEN CAST(cap AS DOUBLE) END) OVER (), 0)) / sum(CASE WHEN NOT capped THEN CAST(weight AS DOUBLE) END) OVER () * weight
    END AS target FROM s4),
s6 AS (SELECT *, sum(target) OVER (ORDER BY no) / sum(target) OVER () AS upto FROM s5),
s7 AS (
  SELECT *, coalesce(lag(upto) OVER (ORDER BY no), 0.0) AS lo FROM s6),
s8 AS (SELECT *, coalesce(lead(lo) OVER (ORDER BY no), 2.0) AS hi FROM s7 WHERE target > 0),
k AS (
  SELECT block, CAST(ceil(total / block) AS BIGINT) AS slots FROM (
    SELECT greatest(16, least(2048, CAST(floor(coalesce(min(target) FILTER (target > 0), 0)) AS BIGINT) // 1000)) AS block,
      floor(sum(target)) AS total FROM s5)),
points AS (SELECT i, ((i % 2147483648) * 1327217885 % 2147483648) / 2147483648.0::DOUBLE AS x FROM k, range(k.slots) t(i)),
slots AS (
  SELECT s8.no, s8.source_size, row_number() OVER (PARTITION BY s8.no ORDER BY i) - 1 AS rank
  FROM points JOIN s8 ON s8.lo <= points.x AND points.x < s8.hi),
plays AS (
  SELECT no, rank % ((source_size + block - 1) // block) AS b, count(*) AS uses FROM slots, k
  WHERE rank < 2 * ((source_size + block - 1) // block) GROUP BY ALL),
streams AS (
  SELECT d.doc_id, d.size, s5.no, s5.source_size, s5.target,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY s5.no ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source),
pieces AS (
  SELECT doc_id, no, start, size, unnest(range(start // block, (start + size - 1) // block + 1)) AS b, block FROM streams, k WHERE size > 0),
taken AS (
  SELECT doc_id, sum(uses * (least((b + 1) * block, start + size) - greatest(b * block, start))) AS taken
  FROM pieces JOIN plays USING (no, b) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM streams LEFT JOIN taken USING (doc_id)
"""

#: Remainders of the CRC-32 polynomial for each byte, by eight halvings.
_HALF = "n"
for _ in range(8):
    _HALF = f"CASE WHEN ({_HALF}) & 1 = 1 THEN xor(3988292384, ({_HALF}) >> 1) ELSE ({_HALF}) >> 1 END" if _HALF == "n" else (
        f"list_transform([{_HALF}], lambda m: CASE WHEN m & 1 = 1 THEN xor(3988292384, m >> 1) ELSE m >> 1 END)[1]")

#: Rebuilt conversations as lists of turns; nodes are distinct list prefixes; a subtree's sum
#: is taken over the prefixes of each node's smallest member.
OP11 = f"""
WITH byte_sums AS (SELECT list_transform(range(256), lambda n: {_HALF}) AS remainders),
t AS (
  SELECT conv_id, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(coalesce(role, '') || chr(0) || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS first_id, xor(list_reduce(
    list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))),
    lambda s, b: xor(s >> 8, remainders[(xor(s, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t), byte_sums),
r AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.x FROM c JOIN t ON t.conv_id = c.first_id AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.x FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h),
seqs AS (
  SELECT c.conv_id, coalesce(list(r.x ORDER BY r.part, r.pos) FILTER (r.x IS NOT NULL), []) AS seq FROM c LEFT JOIN r USING (conv_id) GROUP BY ALL),
occ AS (SELECT conv_id, d AS depth, list_slice(seq, 1, d) AS k, len(seq) AS n FROM seqs, range(len(seq) + 1) g(d)),
nodes AS (
  SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256
  FROM occ GROUP BY k, depth),
kids AS (SELECT list_slice(k, 1, depth - 1) AS k, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
own AS (
  SELECT nodes.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * strlen(k[-1].t) END AS saved
  FROM nodes LEFT JOIN kids USING (k, depth)),
sums AS (
  SELECT o.k, o.depth, count(*) FILTER (own.n_children = 0) AS n_leaves, sum(own.saved) AS saved
  FROM own JOIN occ o ON o.conv_id = own.conv_id AND o.depth <= own.depth GROUP BY ALL)
SELECT own.conv_id, own.depth, up.conv_id AS parent_conv_id, own.n_convs, CAST(own.n_children AS BIGINT) AS n_children, sums.n_leaves,
  CAST(sums.saved AS BIGINT) AS saved_tokens, own.ends_sha256
FROM own JOIN sums USING (k, depth) LEFT JOIN nodes up ON up.depth = own.depth - 1 AND up.k = list_slice(own.k, 1, own.depth - 1)
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_decontamination": OP7, "op9_mixing": OP9, "op11_conversation_trie": OP11}
