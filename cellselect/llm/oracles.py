"""DuckDB text of the queries that SQL can express."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1_NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
        THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o
      FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
      WHERE 100 * o >= 75 * (na.n + nb.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id)
SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.root) AS component_id
FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id
"""

OP2_PREFERENCES = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
                  count(*) OVER (PARTITION BY conv_id) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, max(n) AS n, (max(n) + 1) // 2 AS half FROM t GROUP BY conv_id),
r AS (SELECT t.conv_id, pos, role, text FROM t JOIN ids USING (conv_id) WHERE pos <= half
      UNION ALL
      SELECT ids.conv_id, pos, role, text FROM ids JOIN t ON t.conv_id = ids.conv_id + 1 WHERE pos > ids.half),
rn AS (SELECT conv_id, count(*) AS n FROM r GROUP BY conv_id),
k AS (SELECT ids.conv_id, coalesce(any_value(d.first_off) - 1, least(any_value(ids.n), any_value(coalesce(rn.n, 0)))) AS n_common
      FROM ids LEFT JOIN rn USING (conv_id)
      LEFT JOIN (SELECT t.conv_id, min(t.pos) AS first_off FROM t JOIN r ON r.conv_id = t.conv_id AND r.pos = t.pos
                 WHERE r.role <> t.role OR r.text <> t.text GROUP BY t.conv_id) d USING (conv_id) GROUP BY ids.conv_id),
s AS (SELECT 'c' AS side, conv_id, pos, role, text FROM t UNION ALL SELECT 'r', conv_id, pos, role, text FROM r),
p AS (SELECT side, s.conv_id, pos, role, pos <= n_common AS shared,
             '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' AS body
      FROM s JOIN k USING (conv_id)),
o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY side, conv_id, shared ORDER BY pos
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS place FROM p),
g AS (SELECT side, conv_id, shared, string_agg(head || body || chr(10), '' ORDER BY pos) AS txt,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN CAST(place AS BIGINT) || '-' || CAST(place + length(body) AS BIGINT) END, ',' ORDER BY pos), '') AS spans
      FROM o GROUP BY side, conv_id, shared)
SELECT k.conv_id, CAST(n_common AS INT) AS n_common, coalesce(h.txt, '') AS prompt,
       coalesce(c.txt, '') AS chosen, coalesce(c.spans, '') AS chosen_spans,
       coalesce(j.txt, '') AS rejected, coalesce(j.spans, '') AS rejected_spans
FROM k LEFT JOIN g h ON h.conv_id = k.conv_id AND h.side = 'c' AND h.shared
LEFT JOIN g c ON c.conv_id = k.conv_id AND c.side = 'c' AND NOT c.shared
LEFT JOIN g j ON j.conv_id = k.conv_id AND j.side = 'r' AND NOT j.shared
"""

OP13_COLLOCATIONS = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, 'und') AS lang, {_LOWER} AS t FROM documents),
q AS (SELECT id, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM q),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM (
        SELECT lang, k, unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) AS phrase
        FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k) GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
g AS MATERIALIZED (SELECT * FROM f WHERE f >= 100),
c AS (SELECT lang, k AS size, phrase, string_split(phrase, ' ') AS w, f AS a FROM g WHERE k > 1),
o AS (SELECT lang, a, unnest([array_to_string(w[1:size - 1], ' '), array_to_string(w[2:size], ' ')]) AS phrase FROM c WHERE size > 2),
s AS (SELECT c.lang, c.phrase, c.a, j.k, l.f AS l, r.f AS r, n.n,
             CAST((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
      FROM c JOIN (SELECT unnest([1, 2, 3, 4]) AS k) j ON j.k < c.size
      JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:j.k], ' ')
      JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[j.k + 1:], ' ')
      JOIN n ON n.lang = c.lang
      WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.lang = c.lang AND o.phrase = c.phrase AND o.a = c.a)),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b QUALIFY rank <= 2000
"""

# crc32 is folded over the digits of an id with the table of its 256 bytes, built bit by bit.
OP12_PREFIX_TRIE = """
WITH RECURSIVE bits(i, k, v) AS (
    SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i)
    UNION ALL SELECT i, k + 1, xor(v >> 1, (v & 1) * 3988292384) FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
             coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 100 AS head,
               xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ord(x)::BIGINT)),
                               lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295::BIGINT) % 6 AS h
        FROM (SELECT DISTINCT conv_id FROM t), crc),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, role, text FROM (
        SELECT ids.conv_id, 0 AS part, pos, role, text FROM ids JOIN t ON t.conv_id = ids.head AND t.pos <= ids.h
        UNION ALL SELECT ids.conv_id, 1, pos, role, text FROM ids JOIN t ON t.conv_id = ids.conv_id AND t.pos > ids.h)),
p AS (SELECT conv_id, depth, length(text) AS chars, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS seq FROM r
      UNION ALL SELECT conv_id, 0, 0, [] FROM ids),
m AS MATERIALIZED (SELECT conv_id, depth, chars, min(conv_id) OVER (PARTITION BY depth, seq) AS node,
                          depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM p),
n AS MATERIALIZED (SELECT node, depth, count(*) AS n_convs, any_value(chars) AS chars,
                          sha256(coalesce(string_agg(CASE WHEN last THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
                   FROM m GROUP BY node, depth),
par AS (SELECT n.node, n.depth, m.node AS parent FROM n JOIN m ON m.conv_id = n.node AND m.depth = n.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS c FROM par GROUP BY ALL),
sub AS (SELECT m.node, m.depth, sum(CASE WHEN k.c IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
        FROM n LEFT JOIN kids k ON k.node = n.node AND k.depth = n.depth JOIN m ON m.conv_id = n.node AND m.depth <= n.depth GROUP BY ALL)
SELECT n.node AS conv_id, n.depth, par.parent AS parent_conv_id, n.n_convs, CAST(coalesce(kids.c, 0) AS BIGINT) AS n_children,
       CAST(sub.n_leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM n JOIN sub ON sub.node = n.node AND sub.depth = n.depth
LEFT JOIN par ON par.node = n.node AND par.depth = n.depth LEFT JOIN kids ON kids.node = n.node AND kids.depth = n.depth
"""

OP4_SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT g, min(doc_id) AS least FROM s GROUP BY g),
gone AS (SELECT DISTINCT s.doc_id, unnest(range(i, i + 13)) AS p FROM s JOIN f ON f.g = s.g AND f.least < s.doc_id),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
k AS (SELECT e.doc_id, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN word END, ' ' ORDER BY e.p) AS kept
      FROM e LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.p = e.p GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
