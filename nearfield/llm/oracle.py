"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_PLAIN = r"[^\x20\x09-\x0D]+"

OP2 = f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWERED}, '{_ALNUM}') AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(len(w), 10) AS size, array_to_string(w[i + 1 : i + 10], ' ') AS win FROM (SELECT item, w, unnest(range(greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, size, array_to_string(w[i + 1 : i + size], ' ') AS win FROM (SELECT r, w, size, unnest(range(len(w) - size + 1)) AS i FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size)),
hits AS (SELECT r, i, dw.size AS size, item FROM dw JOIN iw ON dw.win = iw.win AND dw.size = iw.size),
words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)"""

OP4 = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '{_PLAIN}') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT r, md5(array_to_string(w[i + 1 : i + 4], ' ')) AS g FROM (SELECT r, w, unnest(range(greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
links AS MATERIALIZED (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.r < y.r GROUP BY 1, 2) JOIN n p ON p.r = a JOIN n q ON q.r = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least_.component_id FROM d LEFT JOIN n USING (r) JOIN (SELECT reach.a AS r, min(e.doc_id) AS component_id FROM reach JOIN d e ON e.r = reach.b GROUP BY 1) least_ USING (r)"""

# texts as hexadecimal digits, cut into pieces that overlap by a window, so that no substring is far from a piece's beginning
OP7 = """WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT r, c, substr(h, (2000 * c + 1)::BIGINT, 2398) AS p FROM (SELECT r, h, unnest(range(len(h) // 2000 + 1)) AS c FROM d)),
wins AS MATERIALIZED (SELECT r, 1000 * c + i AS pos, md5(substr(p, (2 * i + 1)::BIGINT, 400)) AS g FROM (SELECT r, c, p, unnest(range(least(1000, len(p) // 2 - 199))) AS i FROM pieces WHERE len(p) >= 400)),
again AS (SELECT r, pos FROM wins JOIN (SELECT g FROM wins GROUP BY g HAVING count(*) > 1) USING (g)),
marks AS (SELECT r, pos, pos - coalesce(lag(pos) OVER (PARTITION BY r ORDER BY pos), -1000) > 200 AS fresh FROM again),
spans AS (SELECT r, min(pos) AS a, max(pos) + 200 AS b FROM (SELECT r, pos, sum(fresh::INT) OVER (PARTITION BY r ORDER BY pos) AS k FROM marks) GROUP BY r, k),
gone AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY r),
kept AS (SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS a, a AS b FROM spans UNION ALL SELECT r, coalesce(max(b), 0), max(len(h)) // 2 FROM d LEFT JOIN spans USING (r) GROUP BY r),
left_ AS (SELECT r, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (kept.b - kept.a))::BIGINT), '' ORDER BY a) AS h FROM kept JOIN d USING (r) GROUP BY r)
SELECT d.doc_id, (len(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(left_.h)) AS kept_sha256
FROM d JOIN left_ USING (r) LEFT JOIN gone USING (r)"""

_CUT = "least(h1 % (n + 1), h2 % (n + 1))", "greatest(h1 % (n + 1), h2 % (n + 1))"
OP12 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT doc_id, t, w, len(w) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(w[1 : {_CUT[0]}], '') AS p, array_to_string(w[{_CUT[0]} + 1 : {_CUT[1]}], '') AS m, array_to_string(w[{_CUT[1]} + 1 :], '') AS f FROM h)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || f || '<M>' || m ELSE '<S>' || f || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM c"""

# crc32 by its table, from the polynomial; a run of period q is a stretch of places whose 16 words stand again q words on
OP13 = f"""WITH RECURSIVE poly(i, k, c) AS (SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM poly WHERE k < 8),
steps AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{_PLAIN}') AS w,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT), lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295::BIGINT), 4294967295) AS h FROM documents, steps),
p AS (SELECT *, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d), q AS (SELECT *, 1 + (len(w) - a) // (3 + (h // 10) % 8) AS p FROM p),
x AS MATERIALIZED (SELECT r, doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN list_transform(range(len(w)), lambda i: w[(CASE WHEN i >= a THEN a + (i - a) % p ELSE i END) + 1]) ELSE w END AS w FROM q),
grams AS MATERIALIZED (SELECT r, i, md5(array_to_string(w[i + 1 : i + 16], ' ')) AS g FROM (SELECT r, w, unnest(range(len(w) - 15)) AS i FROM x WHERE len(w) >= 24)),
again AS (SELECT a.r, a.i, b.i - a.i AS q FROM grams a JOIN grams b ON a.r = b.r AND a.g = b.g AND a.i < b.i),
islands AS (SELECT r, q, min(i) AS start, max(i) + 16 + q - min(i) AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM again) GROUP BY r, q, k),
runs AS MATERIALIZED (SELECT r, start, length, min(q) AS period FROM islands WHERE length >= greatest(24, 3 * q) GROUP BY r, start, length),
lists AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS l FROM runs GROUP BY r),
best AS (SELECT r, start, length, period FROM runs a WHERE NOT EXISTS (SELECT 1 FROM runs b WHERE a.r = b.r AND (b.length * a.period > a.length * b.period OR (b.length * a.period = a.length * b.period AND (b.start, b.period) < (a.start, a.period))))),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(v, ' ' ORDER BY i) AS c FROM (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS v FROM x) LEFT JOIN gone USING (r, i) WHERE gone.i IS NULL GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length, period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli, sha256(coalesce(l, '')) AS runs_sha256, sha256(coalesce(c, '')) AS collapsed_sha256
FROM x LEFT JOIN lists USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)"""

ORACLE_SQL = {"op12_fill_in_middle": OP12, "op13_periodic_runs": OP13, "op2_decontamination": OP2, "op4_jaccard_join": OP4, "op7_suffix_dedup": OP7}
