"""DuckDB SQL of the queries that SQL can express. Only built from the tables; nothing is shared with the operators."""

from __future__ import annotations

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP2 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 7)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 7)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, n, line FROM (SELECT doc_id, string_split(t, chr(10)) AS ls FROM d), unnest(ls) WITH ORDINALITY AS u(line, n)),
judged AS (
  SELECT *, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS nw,
    length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS sy,
    regexp_matches(line, '[.!?:;,…。！？]["''”’»)\]]*[\x20\x09-\x0D]*$') AS ended
  FROM lines),
kept AS (
  SELECT *, nw = 0 OR NOT (sy * 5 > length(line) OR (nw < 4 AND NOT ended)
    OR (NOT ended AND regexp_matches(line, '(?:[|»›•·>].*){{2}}'))
    OR (nw <= 12 AND regexp_matches(line, '(?i)(?:all rights reserved|terms of (?:use|service)|privacy policy|cookie policy|accept (?:all )?cookies|click here|read more|sign (?:in|up)|log ?in|subscribe (?:now|to)|share (?:this|on)|enable javascript|lorem ipsum|skip to (?:main )?content|back to top)'))) AS ok
  FROM judged),
by_doc AS (
  SELECT doc_id, count(*) FILTER (nw > 0) - count(DISTINCT line) FILTER (nw > 0) AS dup,
    sum(CASE WHEN ok THEN length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) ELSE 0 END) AS clean
  FROM kept GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, b.dup AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words, b.clean
  FROM d JOIN by_doc b USING (doc_id) LEFT JOIN covered c USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (100 * (word_chars - clean) > 50 * word_chars) AS kept
FROM m
"""

OP5 = """
WITH d AS (
  SELECT doc_id, 'd' || (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS INT), 0) % 4) AS domain,
    coalesce(lang, 'null') AS lang, coalesce(source, 'null') AS source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS n
  FROM documents),
wt(path, w) AS (VALUES ('d0', 4), ('d1', 3), ('d2', 2), ('d0/en', 3), ('d1/en', 3), ('d2/en', 2), ('d3/en', 2), ('d0/en/src0', 2)),
leaf AS (
  SELECT l.*, 2 * tokens AS cap, coalesce(a.w, 1) AS w1, coalesce(b.w, 1) AS w2, coalesce(c.w, 1) AS w3
  FROM (SELECT domain, lang, source, sum(n)::BIGINT AS tokens FROM d GROUP BY ALL) l
  LEFT JOIN wt a ON a.path = domain LEFT JOIN wt b ON b.path = domain || '/' || lang LEFT JOIN wt c ON c.path = domain || '/' || lang || '/' || source
  WHERE tokens > 0),
bl AS (SELECT domain, lang, sum(cap) AS cap, max(w2) AS w, max(w1) AS w1 FROM leaf GROUP BY ALL),
bd AS (SELECT domain, sum(cap) AS cap, max(w1) AS w FROM bl GROUP BY ALL),
b0 AS (SELECT least((SELECT sum(n) FROM d) * 80 // 100, (SELECT sum(cap) FROM bd)) AS b),
c1 AS (SELECT 'r' AS parent, domain AS name, cap, w, b AS pb FROM bd, b0),
e1 AS (SELECT *, sum(cap) OVER o AS cs, coalesce(sum(w) OVER (PARTITION BY parent ORDER BY cap / w, name ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS ws
  FROM c1 WINDOW o AS (PARTITION BY parent ORDER BY cap / w, name ROWS UNBOUNDED PRECEDING)),
f1 AS (SELECT *, cs * w + cap * ws <= pb * w AS fl FROM e1),
g1 AS (SELECT *, pb - sum(CASE WHEN fl THEN cap ELSE 0 END) OVER (PARTITION BY parent) AS lft, coalesce(sum(w) FILTER (NOT fl) OVER (PARTITION BY parent), 1) AS op FROM f1),
h1 AS (SELECT *, CASE WHEN fl THEN cap ELSE w * lft // op END AS fb, w * lft % op AS rest FROM g1),
i1 AS (SELECT *, pb - sum(fb) OVER (PARTITION BY parent) AS spare, row_number() OVER (PARTITION BY parent, fl ORDER BY rest DESC, name) AS turn FROM h1),
r1 AS (SELECT name AS domain, fb + CASE WHEN NOT fl AND turn <= spare THEN 1 ELSE 0 END AS pb FROM i1),
c2 AS (SELECT domain AS parent, lang AS name, cap, w, pb FROM bl JOIN r1 USING (domain)),
e2 AS (SELECT *, sum(cap) OVER o AS cs, coalesce(sum(w) OVER (PARTITION BY parent ORDER BY cap / w, name ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS ws
  FROM c2 WINDOW o AS (PARTITION BY parent ORDER BY cap / w, name ROWS UNBOUNDED PRECEDING)),
f2 AS (SELECT *, cs * w + cap * ws <= pb * w AS fl FROM e2),
g2 AS (SELECT *, pb - sum(CASE WHEN fl THEN cap ELSE 0 END) OVER (PARTITION BY parent) AS lft, coalesce(sum(w) FILTER (NOT fl) OVER (PARTITION BY parent), 1) AS op FROM f2),
h2 AS (SELECT *, CASE WHEN fl THEN cap ELSE w * lft // op END AS fb, w * lft % op AS rest FROM g2),
i2 AS (SELECT *, pb - sum(fb) OVER (PARTITION BY parent) AS spare, row_number() OVER (PARTITION BY parent, fl ORDER BY rest DESC, name) AS turn FROM h2),
r2 AS (SELECT parent AS domain, name AS lang, fb + CASE WHEN NOT fl AND turn <= spare THEN 1 ELSE 0 END AS pb FROM i2),
c3 AS (SELECT domain || '/' || lang AS parent, domain, lang, source AS name, tokens, cap, w3 AS w, pb FROM leaf JOIN r2 USING (domain, lang)),
e3 AS (SELECT *, sum(cap) OVER o AS cs, coalesce(sum(w) OVER (PARTITION BY parent ORDER BY cap / w, name ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS ws
  FROM c3 WINDOW o AS (PARTITION BY parent ORDER BY cap / w, name ROWS UNBOUNDED PRECEDING)),
f3 AS (SELECT *, cs * w + cap * ws <= pb * w AS fl FROM e3),
g3 AS (SELECT *, pb - sum(CASE WHEN fl THEN cap ELSE 0 END) OVER (PARTITION BY parent) AS lft, coalesce(sum(w) FILTER (NOT fl) OVER (PARTITION BY parent), 1) AS op FROM f3),
h3 AS (SELECT *, CASE WHEN fl THEN cap ELSE w * lft // op END AS fb, w * lft % op AS rest FROM g3),
i3 AS (SELECT *, pb - sum(fb) OVER (PARTITION BY parent) AS spare, row_number() OVER (PARTITION BY parent, fl ORDER BY rest DESC, name) AS turn FROM h3),
r3 AS (SELECT domain, lang, name AS source, tokens, fb + CASE WHEN NOT fl AND turn <= spare THEN 1 ELSE 0 END AS b FROM i3),
t AS (SELECT d.*, b // tokens AS whole, b % tokens AS part, md5('29:' || (b // tokens + 1)::BIGINT || ':' || doc_id) AS h FROM d LEFT JOIN r3 USING (domain, lang, source)),
s AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h) AS upto FROM t)
SELECT doc_id, domain, lang, source, n AS n_tokens, coalesce(whole + CASE WHEN upto <= part THEN 1 ELSE 0 END, 0)::INT AS epochs FROM s
"""

OP8 = """
WITH p AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM q JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM q LEFT JOIN f USING (page_id)
"""

OP7 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (WITH RECURSIVE reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a) SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(r.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.a = d.doc_id
"""

OP11 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS total FROM d WHERE len(w) > 0),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark),
p AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
f AS (SELECT t, floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t, docs),
m AS (SELECT doc_id, 100 - 50 + (50 * len(w) * docs) // total AS m FROM d, s),
r AS (
  SELECT item_id, doc_id, sum(f.w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN f USING (t) JOIN p USING (t) JOIN m USING (doc_id) GROUP BY ALL HAVING score > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM r QUALIFY rank <= 50
"""

OP12 = r"""
WITH p AS (
  SELECT row_number() OVER () AS piece, lang, t FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t FROM documents)),
w AS (SELECT lang, list_filter(regexp_split_to_array(t, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
h AS (SELECT * FROM f WHERE a >= 30),
c AS (SELECT * FROM h WHERE k > 1),
cut AS (
  SELECT c.lang, c.k, c.g, c.a, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a) // (x.a + y.a) AS score, s.s
  FROM c JOIN (SELECT unnest([1, 2, 3]) AS s) s ON s.s < c.k JOIN h x ON x.lang = c.lang AND x.g = c.g[:s.s] JOIN h y ON y.lang = c.lang AND y.g = c.g[s.s + 1:]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, s) = 1),
inner_parts AS (
  SELECT lang, k, a, g[i:i + m - 1] AS part FROM (SELECT lang, k, a, g, m, unnest(generate_series(1, k - m + 1)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k)),
gone AS (SELECT DISTINCT c.lang, c.g FROM c JOIN inner_parts q ON q.lang = c.lang AND q.part = c.g AND 100 * q.a >= 80 * c.a),
z AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score::BIGINT AS score FROM best ANTI JOIN gone USING (lang, g))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase COLLATE "C") AS rank, phrase, a, l, r, n, score
FROM z JOIN n USING (lang) QUALIFY rank <= 2000
"""

SQL: dict[str, str] = {"op11_ranked_search": OP11, "op12_collocations": OP12, "op2_quality": OP2, "op5_mixing": OP5, "op7_ngram_join": OP7, "op8_url_filter": OP8}
