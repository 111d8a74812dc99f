"""DuckDB SQL for the operators that SQL can express."""

OP2 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) || '|' || (row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1)::VARCHAR), 1, 8))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
lv AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS lev FROM r
  WINDOW w AS (ORDER BY cap / weight, weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (SELECT arg_min(lev, cap / weight) FROM lv WHERE lev * weight <= cap) AS found FROM lv),
t AS (SELECT source, source_size, CASE WHEN found IS NULL THEN cap ELSE least(cap, found * weight) END AS target FROM f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
q AS (SELECT *, target - whole * source_size AS rest FROM p),
c AS (SELECT d.source, d.h, q.rest, sum(d.size) AS size FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source WHERE q.whole < 3 GROUP BY ALL),
u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h) AS upto FROM c),
e AS (SELECT source, min(h) AS h FROM u WHERE upto > rest GROUP BY source),
k AS (SELECT u.source, CASE WHEN u.upto - u.rest < u.rest - (u.upto - u.size) THEN u.h + 1 ELSE u.h END AS threshold FROM u JOIN e ON u.source IS NOT DISTINCT FROM e.source AND u.h = e.h)
SELECT d.doc_id, d.size, q.source_size, q.target, times * d.size AS taken, times
FROM (SELECT d.*, least(q.whole + CASE WHEN d.h < coalesce(k.threshold, 0) THEN 1 ELSE 0 END, 3)::BIGINT AS times
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source) d
JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""

OP3 = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
n AS (SELECT *, least(10, len(ws)) AS n FROM b WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[i : i + n - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM n)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT r, n, i, array_to_string(ws[i : i + n - 1], ' ') AS win FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes)),
hit AS (SELECT r, i, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
per AS (SELECT r, count(DISTINCT place) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS joined FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN per USING (r) LEFT JOIN ids USING (r)
"""

OP7 = r"""
WITH p AS (
  SELECT page_id, url, '"' || md5(coalesce(html, '')) || '"' AS etag, 'sha256:' || sha256(coalesce(html, '')) AS digest,
    regexp_replace(regexp_replace(trim(coalesce(url, '')), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS u0 FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(u0, '([?&])(utm_[a-z]+|ref|fbclid|gclid)=[^&]*', '\1', 'g'), '&+', '&', 'g'), '[?&]+$', ''), '\?&', '?', 'g') AS u FROM p),
k AS (SELECT *, regexp_extract(u, '^[^/?]*') AS host FROM q),
c AS (SELECT *, regexp_replace(regexp_replace(lower(host), '^www\.', ''), ':(80|443)$', '') || regexp_replace(substr(u, len(host) + 1), '/+$', '') AS key FROM k),
m AS (SELECT r.page_id * 2 + 1 AS record_id, r.url, r.page_id + 86400 AS ts, r.etag, max_by(a.page_id, a.page_id) AS resp
  FROM c r LEFT JOIN c a ON a.key = r.key AND a.page_id <= r.page_id + 86400 AND a.page_id % 7 <> 3 GROUP BY ALL)
SELECT m.record_id, m.url, m.ts, m.resp * 2 AS response_id, CASE WHEN m.resp IS NULL THEN 'no_response' WHEN a.etag = m.etag THEN 'resolved' ELSE 'mismatch' END AS outcome,
  CASE WHEN a.etag = m.etag THEN a.digest END AS digest, m.etag, m.ts::VARCHAR AS date, CASE WHEN a.etag = m.etag THEN 'text/html' ELSE 'text/plain' END AS content_type
FROM m LEFT JOIN c a ON a.page_id = m.resp
"""

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT r, i, ws[i : i + 4] AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM d)),
rep AS (SELECT r, unnest(range(i, i + 5)) AS place FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT place) AS n_repeat_words FROM rep GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT r, doc_id, len(ws)::BIGINT AS n_words, len(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN dup USING (r) LEFT JOIN cov USING (r)),
b AS (SELECT *, (CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END + CASE WHEN 100 * n_symbols > 5 * word_chars THEN 4 ELSE 0 END
  + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars > 30 * n_words OR word_chars * 2 < n_words * 3 THEN 16 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits, 2 AS policy_version FROM b
"""

OP10 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok', 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok', 'assistant', '\### Assistant: </turn> ok'),
x AS (SELECT *, len(regexp_replace(role || text, '[^\\<>]', '', 'g')) AS escapes FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN len(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(len(role) + len(text) + escapes + 17)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
"""

SQL = {"op2_mixing": OP2, "op3_decontamination": OP3, "op7_warc": OP7, "op8_quality_rules": OP8, "op10_chat": OP10}
