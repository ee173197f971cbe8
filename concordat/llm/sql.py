"""DuckDB texts for the operators that SQL can express, written from the contracts and not from the operators."""

OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CAST([3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3) + 1] AS BIGINT) AS w
  FROM sized GROUP BY source),
filled AS (
  SELECT *, sum(source_size) OVER () AS all_size,
         coalesce(sum(2 * source_size) OVER before, 0)::DOUBLE AS full_before,
         (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS w_rest
  FROM src
  WINDOW before AS (ORDER BY 2 * source_size / w::DOUBLE, source IS NULL, source COLLATE "C" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (1.5 * all_size::DOUBLE - full_before) / w_rest AS lev FROM filled),
cut AS (SELECT max(lev) AS lev FROM levels),
tgt AS (
  SELECT source, source_size,
         CASE WHEN 2 * source_size / w::DOUBLE <= cut.lev THEN 2.0::DOUBLE * source_size ELSE cut.lev * w END AS target
  FROM levels, cut),
ordered AS (
  SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s)
SELECT o.doc_id, o.size, t.source_size, t.target,
       (CASE WHEN t.source_size = 0 THEN 0 ELSE
         CAST(floor(round(t.target) / t.source_size) AS BIGINT) * o.size
         + greatest(0, least(o.size, CAST(round(t.target) AS BIGINT)
             - CAST(floor(round(t.target) / t.source_size) AS BIGINT) * t.source_size - o.before)) END)::BIGINT AS taken
FROM ordered o JOIN tgt t ON o.source IS NOT DISTINCT FROM t.source
"""

OP3 = r"""
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id, words FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents)),
iw AS (
  SELECT item_id, words, least(13, len(words)) AS n FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark) WHERE len(words) > 0),
grams AS (
  SELECT DISTINCT item_id, n, array_to_string(words[p:p + n - 1], ' ') AS g
  FROM (SELECT item_id, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM iw)),
widths AS (SELECT DISTINCT n FROM iw),
wins AS (
  SELECT rid, n, p, array_to_string(words[p:p + n - 1], ' ') AS g
  FROM (SELECT rid, words, n, unnest(range(1, len(words) - n + 2)) AS p FROM dw, widths WHERE len(words) >= n)),
hits AS (SELECT w.rid, w.n, w.p, g.item_id FROM wins w JOIN grams g USING (n, g)),
cov AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT rid, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT rid, n, p FROM hits)) GROUP BY rid),
its AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM dw LEFT JOIN cov USING (rid) LEFT JOIN its USING (rid)
"""

OP10 = r"""
WITH RECURSIVE dw AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, hash(s) AS s FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, len(words) - 2), lambda p: array_to_string(words[p:p + 3], ' ')) END) AS s FROM dw)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sizes u ON u.doc_id = a JOIN sizes v ON v.doc_id = b WHERE 100 * o >= 85 * (u.n + v.n - o)),
reach AS (
  SELECT doc_id AS node, doc_id AS label FROM documents
  UNION SELECT l.a, r.label FROM reach r JOIN links l ON l.b = r.node)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.label AS component_id, coalesce(k.n, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT node, min(label) AS label FROM reach GROUP BY node) c ON c.node = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = d.doc_id
"""

OP7 = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, len(text) AS n FROM conversations),
calls AS MATERIALIZED (
  SELECT conv_id, turn, 'call_' || turn AS call_id, text, n,
    ['search', 'lookup', 'translate', 'browse'][n % 4 + 1] AS name, n % 13 <> 0 AS readable,
    n % 5 = 0 AS text_limit, n % 3 = 0 AS has_key, n % 2 = 0 AS has_exact,
    CASE n % 3 WHEN 0 THEN [turn - 2] WHEN 1 THEN [turn - 4, turn + 2] ELSE [] END AS after
  FROM t WHERE role = 'assistant'),
deps AS MATERIALIZED (
  SELECT a.conv_id, a.turn, b.turn AS dep FROM (SELECT conv_id, turn, unnest(after) AS dep FROM calls) a
  JOIN calls b ON b.conv_id = a.conv_id AND b.turn = a.dep),
paths AS (
  SELECT conv_id, turn, 0 AS level FROM calls
  UNION SELECT d.conv_id, d.turn, p.level + 1 FROM paths p JOIN deps d ON d.conv_id = p.conv_id AND d.dep = p.turn WHERE p.level < 1000),
depth AS (SELECT conv_id, turn, CASE WHEN max(level) < 1000 THEN max(level) END AS level FROM paths GROUP BY ALL),
given AS (
  SELECT conv_id, turn, unnest([{'f': 'to', 'ty': 'string'}, {'f': 'query', 'ty': 'string'},
    {'f': 'limit', 'ty': CASE WHEN text_limit THEN 'string' ELSE 'integer' END},
    {'f': 'key', 'ty': CASE WHEN has_key THEN 'string' END}, {'f': 'exact', 'ty': CASE WHEN has_exact THEN 'boolean' END}], recursive := true)
  FROM calls WHERE readable),
sch(name, f, ty, required) AS (VALUES ('search', 'query', 'string', true), ('search', 'limit', 'integer', false), ('search', 'exact', 'boolean', false),
  ('lookup', 'key', 'string', true), ('lookup', 'limit', 'integer', true), ('translate', 'text', 'string', true), ('translate', 'to', 'string', true)),
errs AS (
  SELECT conv_id, turn, 'tool' AS e FROM calls WHERE name = 'browse'
  UNION ALL SELECT conv_id, turn, 'json' FROM calls WHERE NOT readable
  UNION ALL SELECT c.conv_id, c.turn, 'missing ' || s.f FROM calls c JOIN sch s USING (name)
    WHERE readable AND required AND NOT EXISTS (SELECT 1 FROM given g WHERE g.conv_id = c.conv_id AND g.turn = c.turn AND g.f = s.f AND g.ty IS NOT NULL)
  UNION ALL SELECT c.conv_id, c.turn, CASE WHEN s.f IS NULL THEN 'unknown ' ELSE 'type ' END || g.f
    FROM calls c JOIN given g USING (conv_id, turn) LEFT JOIN sch s ON s.name = c.name AND s.f = g.f
    WHERE c.name <> 'browse' AND g.ty IS NOT NULL AND (s.f IS NULL OR s.ty <> g.ty)),
err AS (SELECT conv_id, turn, string_agg(e, ',' ORDER BY e) AS errors FROM errs GROUP BY ALL),
res AS (SELECT conv_id, turn - 1 AS turn, count(*) AS n_results, min(text) AS content FROM t WHERE role = 'user' GROUP BY ALL)
SELECT c.conv_id, c.call_id, c.name, d.level::BIGINT AS level,
  (row_number() OVER (PARTITION BY c.conv_id ORDER BY d.level NULLS LAST, md5(c.call_id)) - 1)::BIGINT AS position,
  coalesce(r.n_results, 0)::BIGINT AS n_results, coalesce(e.errors, '') AS errors, e.errors IS NULL AS valid,
  '{"arguments":' || CASE WHEN NOT readable THEN 'null' ELSE '{"exact":' || CASE WHEN has_exact THEN 'true' ELSE 'null' END
      || CASE WHEN has_key THEN ',"key":"k' || c.turn || '"' ELSE '' END || ',"limit":' || CASE WHEN text_limit THEN '"ten"' ELSE n::VARCHAR END
      || ',"query":' || to_json(c.text)::VARCHAR || ',"to":"en"}' END
    || ',"call_id":"' || c.call_id || '","name":"' || c.name || '","result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' AS message
FROM calls c JOIN depth d USING (conv_id, turn) LEFT JOIN res r USING (conv_id, turn) LEFT JOIN err e USING (conv_id, turn)
"""

OP11 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
t AS MATERIALIZED (SELECT lang, source, term, rid, count(*) AS n FROM (SELECT lang, source, rid, unnest(words) AS term FROM d) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, sum(n)::BIGINT AS n FROM t GROUP BY lang, term HAVING count(*) >= 3),
langs AS (SELECT lang, (SELECT count(*) FROM kept k WHERE k.lang = d.lang) AS v, (SELECT coalesce(sum(n), 0) FROM kept k WHERE k.lang = d.lang) AS total FROM (SELECT DISTINCT lang FROM d) d),
grp AS (SELECT DISTINCT lang, source FROM d),
cells AS MATERIALIZED (SELECT t.lang, t.source, t.term, sum(t.n)::BIGINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
sums AS (SELECT lang, source, sum(n) AS total FROM cells GROUP BY ALL),
p AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1::HUGEINT + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + l.v)::HUGEINT AS p,
         1::HUGEINT + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v)::HUGEINT AS q
  FROM grp g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source
  LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(f.value, 0)::BIGINT AS value
  FROM grp g JOIN grp h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) f
    ON f.lang = g.lang AND f.source = g.source AND f.item = h.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
QUALIFY part = 'pair' OR rank <= 200
"""

OP12 = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
i AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
s AS (SELECT count(*) FILTER (len(words) > 0) AS docs, sum(len(words))::HUGEINT AS terms FROM d),
tf AS MATERIALIZED (SELECT rid, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT rid, doc_id, len(words)::BIGINT AS n, unnest(words) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(s.docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, s GROUP BY term),
scored AS (
  SELECT i.item_id, rid, doc_id,
    sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (10 + ((90::HUGEINT * tf.n * s.docs) // s.terms)::BIGINT))))::BIGINT AS score
  FROM i JOIN tf USING (term) JOIN w USING (term), s GROUP BY ALL),
ranked AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""

ORACLES = {"op1_mix": OP1, "op3_decontaminate": OP3, "op7_tool_calls": OP7, "op10_ngram_join": OP10, "op11_source_divergence": OP11, "op12_lexical_search": OP12}
