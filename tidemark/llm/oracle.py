"""The queries of this subpackage that SQL can express, written on their own for another engine."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"

SHARDING = """
WITH RECURSIVE tab(i, k, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM tab WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8
), raw AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size, flatten(list_transform(string_split(coalesce(text, ''), ''), lambda ch: CASE WHEN ch = '' THEN []::INTEGER[] WHEN unicode(ch) < 128 THEN [unicode(ch)]
    WHEN unicode(ch) < 2048 THEN [192 + unicode(ch) // 64, 128 + unicode(ch) % 64] WHEN unicode(ch) < 65536 THEN [224 + unicode(ch) // 4096, 128 + unicode(ch) // 64 % 64, 128 + unicode(ch) % 64]
    ELSE [240 + unicode(ch) // 262144, 128 + unicode(ch) // 4096 % 64, 128 + unicode(ch) // 64 % 64, 128 + unicode(ch) % 64] END)) AS bytes FROM documents
), sums AS (
  SELECT doc_id, CAST(size AS BIGINT) AS size, xor(list_reduce(list_transform(bytes, lambda b: b::BIGINT), lambda a, b: xor(a >> 8, t[1 + xor(a, b) % 256]), 4294967295::BIGINT), 4294967295::BIGINT) AS text_crc32 FROM raw, crc
), jump(doc_id, place, next, state) AS (
  SELECT doc_id, CAST(-1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(doc_id AS HUGEINT) FROM documents
  UNION ALL
  SELECT doc_id, next, floor((next + 1.0) * (2147483648.0 / CAST(s // 8589934592 + 1 AS DOUBLE))), s
  FROM (SELECT doc_id, next, (state * 2862933555777941757 + 1) % 18446744073709551616 AS s FROM jump WHERE next < 41)
), shards AS (
  SELECT doc_id, CAST(max(CASE WHEN place < 40 THEN place END) AS INTEGER) AS shard, CAST(max(place) AS INTEGER) AS grown_shard FROM jump GROUP BY doc_id
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS BIGINT) AS slot, grown_shard FROM sums JOIN shards USING (doc_id)
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p : p + least(4, len(w)) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(4, len(w)) + 2)) AS p FROM w WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), e AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n i ON i.doc_id = a.doc_id JOIN n j ON j.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, i.n, j.n HAVING 100 * count(*) >= 80 * (i.n + j.n - count(*))
), reach(x, y) AS (
  SELECT x, x FROM e UNION SELECT r.x, e.y FROM reach r JOIN e ON e.x = r.y
), c AS (
  SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

SUFFIX_DEDUP = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), blk AS (
  SELECT doc_id, n, b, substr(h, CAST(2 * b + 1 AS BIGINT), 498) AS part FROM (SELECT doc_id, n, h, unnest(range(0, n - 49, 200)) AS b FROM d WHERE n >= 50)
), g AS (
  SELECT doc_id, b + q AS p, md5(substr(part, CAST(2 * q + 1 AS BIGINT), 100)) AS m FROM (SELECT doc_id, b, part, unnest(range(0, least(200, n - 49 - b))) AS q FROM blk)
), f AS (
  SELECT m, min(doc_id) AS first FROM g GROUP BY m
), hit AS (
  SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM g JOIN f USING (m) WHERE first < doc_id
), isl AS (
  SELECT doc_id, p, sum(CASE WHEN p - before <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM hit
), span AS (
  SELECT doc_id, i, min(p) AS a, max(p) + 50 AS b FROM isl GROUP BY doc_id, i
), gap AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM span UNION ALL SELECT doc_id, max(b), NULL FROM span GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(substr(h, CAST(2 * g.a + 1 AS BIGINT), CAST(2 * (coalesce(g.b, n) - g.a) AS BIGINT)), '' ORDER BY g.a) AS k FROM gap g JOIN d USING (doc_id) GROUP BY doc_id
), r AS (
  SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS spans FROM span GROUP BY doc_id
)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

DECONTAMINATION = f"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, m, array_to_string(w[p : p + m - 1], ' ') AS s FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM iw WHERE len(w) > 0)
), pos AS (
  SELECT doc_id, m, p, array_to_string(w[p : p + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM dw, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)
), occ AS (
  SELECT doc_id, p, m, item_id FROM pos JOIN win USING (m, s)
), hit AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + m)) AS k FROM occ) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM occ) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""

WARC = """
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages
), b AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS of, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(
    ((16 * (instr('0123456789abcdef', substr(h, 5 * i // 4 + 1, 1)) - 1) + greatest(0, instr('0123456789abcdef', substr(h, 5 * i // 4 + 2, 1)) - 1)) >> CAST(3 - 5 * i % 4 AS BIGINT)) & 31 AS BIGINT), 1)), '') AS digest FROM p
)
SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, digest AS payload_digest, CASE WHEN page_id = of THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < of THEN of END AS refers_to,
  coalesce(url, 'urn:page:' || page_id) AS uri, '2024-01-01T00:00:00Z' AS date FROM b
"""

MIXING = """
WITH RECURSIVE seeds(k, h, l) AS (
  SELECT 0, CAST(48271 AS BIGINT), CAST(48271 AS BIGINT) * 48271 % 2147483647 UNION ALL SELECT k + 1, l * 48271 % 2147483647, l * 48271 % 2147483647 * 48271 % 2147483647 FROM seeds WHERE k < 63
), d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 13) AS BIGINT) AS g FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS z, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER up AS i, sum(z) OVER () - coalesce(sum(3 * z) OVER (up ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (up ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM s WINDOW up AS (ORDER BY CAST(z AS DOUBLE) / w, source)
), level AS (
  SELECT CAST(rest AS DOUBLE) AS rest, CAST(free AS DOUBLE) AS free FROM o WHERE 3 * z * free >= rest * w ORDER BY i LIMIT 1
), t AS (
  SELECT source, z, least(CAST(3 * z AS DOUBLE), CAST(w AS DOUBLE) * rest / free) AS target FROM s, level
), r AS (
  SELECT d.*, z, target, CASE WHEN z > 0 THEN target / z ELSE 0 END AS rate FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), drawn AS (
  SELECT r.*, k, CAST(floor(rate) AS BIGINT) + CASE WHEN CAST((h * (g // 67108864) + l * (g % 67108864)) % 2147483647 AS DOUBLE) < (rate - floor(rate)) * 2147483647 THEN 1 ELSE 0 END AS copies FROM r, seeds
), best AS (
  SELECT source, k FROM drawn GROUP BY source, k, target QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(sum(size * copies) - target), k) = 1
)
SELECT doc_id, size, z AS source_size, target, rate, size * copies AS taken FROM drawn JOIN best ON drawn.k = best.k AND drawn.source IS NOT DISTINCT FROM best.source
"""

CONVERSATION_TRIE = """
WITH RECURSIVE tab(i, k, c) AS (
  SELECT i, 0, CAST(i AS BIGINT) FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM tab WHERE k < 8
), crc AS (
  SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8
), c AS (
  SELECT conv_id, count(*) AS n FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, conv_id - conv_id % 100 AS b, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: unicode(x)::BIGINT)), lambda a, x: xor(a >> 8, t[1 + xor(a, x) % 256])), 4294967295::BIGINT) % 6 AS h FROM c, crc
), t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g, length(coalesce(text, '')) AS chars FROM conversations
), r AS (
  SELECT h.conv_id, p AS d, g, chars FROM h JOIN t ON t.conv_id = b AND p <= h.h
  UNION ALL SELECT h.conv_id, p - h.h + least(h.h, coalesce(bc.n, 0)), g, chars FROM h JOIN t ON t.conv_id = h.conv_id AND p > h.h LEFT JOIN c bc ON bc.conv_id = b
), p AS (
  SELECT conv_id, d, chars, md5(string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c
), n AS (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM p GROUP BY d, k
), f AS (
  SELECT n.*, q.k AS above, m.conv_id AS parent FROM n LEFT JOIN p q ON q.conv_id = n.conv_id AND q.d = n.d - 1 LEFT JOIN n m ON m.d = q.d AND m.k = q.k
), kids AS (
  SELECT d - 1 AS d, above AS k, count(*) AS kids FROM f WHERE d > 0 GROUP BY ALL
), x AS (
  SELECT f.*, coalesce(kids, 0) AS kids FROM f LEFT JOIN kids ON kids.d = f.d AND kids.k = f.k
), under AS (
  SELECT p.d, p.k, count(*) FILTER (x.kids = 0) AS leaves, CAST(sum((x.n - 1) * x.chars) AS BIGINT) AS saved FROM p JOIN x ON x.conv_id = p.conv_id AND x.d >= p.d GROUP BY p.d, p.k
), ends AS (
  SELECT d, k, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM p) WHERE d = last GROUP BY d, k
)
SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, parent AS parent_conv_id, x.n AS n_convs, kids AS n_children, leaves AS n_leaves, saved AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM x JOIN under ON under.d = x.d AND under.k = x.k LEFT JOIN ends ON ends.d = x.d AND ends.k = x.k
"""

SQL = {"op1_sharding": SHARDING, "op3_near_duplicates": NEAR_DUPLICATES, "op5_suffix_dedup": SUFFIX_DEDUP, "op6_decontamination": DECONTAMINATION, "op10_warc": WARC, "op11_mixing": MIXING, "op12_conversation_trie": CONVERSATION_TRIE}
