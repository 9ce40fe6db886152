"""DuckDB SQL for the registered queries that SQL can express, written from the rules."""

OP9 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         row_number() OVER () AS rid
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT rid, n, i, list_slice(w, i, i + n - 1) AS win
  FROM (SELECT rid, n, w, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT p.rid, p.i, p.n, x.item FROM places p JOIN windows x USING (n, win)),
words AS (SELECT rid, count(*) AS n_hit FROM (
  SELECT DISTINCT rid, unnest(range(i, i + n)) AS pos FROM (SELECT DISTINCT rid, i, n FROM found)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT rid, item FROM found WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

OP10 = r"""
WITH l AS (
  SELECT rid, doc_id, i, lines[i] AS line,
         translate(regexp_replace(lines[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
shared AS (SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= 10
           GROUP BY key HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INT)) >= 2),
marked AS (SELECT l.*, s.key IS NOT NULL AND l.doc_id IS DISTINCT FROM s.owner AS gone FROM l LEFT JOIN shared s USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid, doc_id
"""

OP2 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, text, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (SELECT rid, i, list_slice(w, i, i + 4) AS win
            FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS pos FROM twice) GROUP BY rid),
lines AS (SELECT rid, doc_id, source, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words,
                 regexp_replace(translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') AS key
          FROM (SELECT rid, doc_id, source, text, unnest(string_split(t, chr(10))) AS line FROM d)),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines WHERE words > 0 GROUP BY rid),
above AS (SELECT source, key FROM lines WHERE words > 0 GROUP BY source, key
          HAVING count(DISTINCT struct_pack(doc_id := doc_id, text := text)) > 10),
lost AS (SELECT l.rid, sum(l.words) AS n FROM lines l JOIN above a
           ON l.key = a.key AND l.source IS NOT DISTINCT FROM a.source WHERE l.words > 0 GROUP BY l.rid),
base AS (
  SELECT d.*, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(lost.n, 0) AS BIGINT) AS n_line_words
  FROM d LEFT JOIN dup USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_line_words,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words - n_line_words >= 0.5 * n_words AS kept
FROM base
"""


def op4(notices: list[tuple[str, str]]) -> str:
    """Every window of every text checked against every notice it shares a shingle with."""
    rows = ", ".join("('" + a + "', '" + b.replace("'", "''") + "')" for a, b in notices)
    words = r"""regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
    return rf"""
WITH n AS (SELECT row_number() OVER () AS nid, license, {words.format('notice')} AS w FROM (VALUES {rows}) v(license, notice)),
ns AS (SELECT nid, license, len(w) - 2 AS n, list_distinct(list_transform(range(1, len(w) - 1), lambda i: list_slice(w, i, i + 2))) AS own FROM n),
d AS (SELECT row_number() OVER () AS rid, doc_id, {words.format('text')} AS w FROM documents),
s AS (SELECT rid, w, i - 1 AS pos, list_slice(w, i, i + 2) AS sh, greatest(len(w) - 2, 1) AS size
      FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
hit AS (SELECT s.rid, s.pos, s.size, x.nid, x.sh FROM s JOIN (SELECT nid, unnest(own) AS sh FROM ns) x ON s.sh = x.sh),
near AS (SELECT DISTINCT rid, nid, p FROM (
  SELECT rid, nid, pos, size, unnest(range(0, greatest(size - 6 + 3, 0) + 1, 4)) AS p FROM hit) WHERE pos >= p AND pos < p + 6),
each AS (SELECT nid, license, len(own) AS size, unnest(own) AS sh FROM ns),
same AS (SELECT a.nid, b.nid AS other FROM each a JOIN each b ON a.sh = b.sh AND a.license <> b.license
         GROUP BY a.nid, b.nid, a.size HAVING count(*) >= 0.8 * a.size),
marks AS (SELECT DISTINCT e.nid, e.sh FROM each e JOIN same USING (nid)
          WHERE NOT EXISTS (SELECT 1 FROM each o WHERE o.nid = same.other AND o.sh = e.sh)),
needed AS (SELECT nid, count(*) AS k FROM marks GROUP BY nid),
share AS (SELECT near.rid, near.nid, p, count(DISTINCT h.sh) / any_value(len(ns.own)) AS share, count(DISTINCT m.sh) AS marked
          FROM near JOIN ns USING (nid) JOIN hit h ON h.rid = near.rid AND h.nid = near.nid
            AND h.pos >= greatest(p - ns.n, 0) AND h.pos < p + 6 + ns.n
          LEFT JOIN marks m ON m.nid = h.nid AND m.sh = h.sh GROUP BY near.rid, near.nid, p),
found AS (SELECT rid, string_agg(license, ',' ORDER BY license) AS licenses, count(*) AS k
          FROM (SELECT DISTINCT rid, license FROM share JOIN ns USING (nid) LEFT JOIN needed ON needed.nid = share.nid
                WHERE share >= 0.8 AND marked = coalesce(needed.k, 0)) GROUP BY rid)
SELECT doc_id, CAST(coalesce(k, 0) AS BIGINT) AS n_licenses, coalesce(licenses, '') AS licenses FROM d LEFT JOIN found USING (rid)
"""


OP13 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1 AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM first OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p JOIN f USING (html)
"""

#: crc32 of the decimal conv_id, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda c, x: list_reduce(list_prepend(xor(c, x), list_transform(range(8), lambda i: CAST(i AS BIGINT))),
    lambda a, i: xor(a >> 1, 3988292384 * (a & 1)))), 4294967295)"""

OP11 = f"""
WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
           FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM t GROUP BY conv_id),
built AS (
  SELECT c.conv_id, t.pos AS d, role, text FROM c JOIN t ON t.conv_id = c.base WHERE t.pos <= h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + t.pos - c.h, role, text
  FROM c JOIN t ON t.conv_id = c.conv_id LEFT JOIN c b ON b.conv_id = c.base WHERE t.pos > c.h),
s AS (SELECT c.conv_id, coalesce(list(struct_pack(role := role, text := text) ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS s
      FROM c LEFT JOIN built USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, len(s) AS size, d, list_slice(s, 1, d) AS key FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM s)),
nodes AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d), '')) AS ends_sha256
          FROM p GROUP BY key, d),
kids AS (SELECT list_slice(key, 1, d - 1) AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY list_slice(key, 1, d - 1)),
own AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children,
               CASE WHEN d > 0 THEN (n_convs - 1) * strlen(key[-1].text) ELSE 0 END AS weight FROM nodes LEFT JOIN kids USING (key)),
sums AS (SELECT p.key, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(weight) AS saved
         FROM own JOIN p ON p.conv_id = own.conv_id AND p.d <= own.d GROUP BY p.key)
SELECT o.conv_id, CAST(o.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, o.ends_sha256
FROM own o JOIN sums ON sums.key = o.key LEFT JOIN nodes up ON o.d > 0 AND up.d = o.d - 1 AND up.key = list_slice(o.key, 1, o.d - 1)
"""
