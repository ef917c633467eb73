"""DuckDB SQL for those operators that SQL expresses on whole tables."""

OP1 = r"""
WITH t AS (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL),
raw AS (SELECT text, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS ln FROM t),
tok AS (
  SELECT text, ln, list_filter(string_split_regex(regexp_replace(raw, '[^ \t\r\f]*[0-9][^ \t\r\f]*', '<*>', 'g'), '[ \t\r\f]+'), lambda x: x <> '') AS w
  FROM raw WHERE regexp_matches(raw, '[^ \t\r\f]')),
l AS (SELECT text, ln, w, CAST(len(w) AS VARCHAR) || ' ' || array_to_string(w[1:4], ' ') AS leaf, array_to_string(w, ' ') AS line FROM tok),
leaves AS (SELECT leaf FROM l GROUP BY leaf HAVING count(DISTINCT text) >= 10),
f AS (SELECT l.* FROM l SEMI JOIN leaves USING (leaf)),
d AS (SELECT leaf, line, any_value(w) AS w, count(DISTINCT text) AS texts FROM f GROUP BY ALL),
k AS (SELECT leaf, line, texts, unnest(w) AS token, unnest(range(len(w))) AS p FROM d),
fx AS (SELECT leaf, p, token FROM k GROUP BY ALL HAVING sum(texts) >= 10 AND token <> '<*>'),
g AS (
  SELECT k.leaf, k.line, string_agg(CASE WHEN fx.token IS NULL THEN '<*>' ELSE k.token END, ' ' ORDER BY k.p) AS template, count(fx.token) AS fixed, count(*) AS n
  FROM k LEFT JOIN fx ON k.leaf = fx.leaf AND k.p = fx.p AND k.token = fx.token GROUP BY ALL),
m AS (SELECT f.text, f.ln, g.template FROM f JOIN g USING (leaf, line) WHERE g.fixed >= 0.6 * g.n),
r AS (SELECT template FROM m GROUP BY 1 HAVING count(DISTINCT text) >= 10),
dr AS (SELECT text, list(DISTINCT ln) AS drops FROM m SEMI JOIN r USING (template) GROUP BY 1)
SELECT doc_id, CAST(len(list_filter(coalesce(string_split(text, chr(10)), []), lambda x: regexp_matches(x, '[^ \t\r\f]'))) AS BIGINT) AS n_lines,
       CAST(coalesce(len(drops), 0) AS BIGINT) AS n_dropped,
       sha256(CASE WHEN drops IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(drops, i - 1)), chr(10)) END) AS text_sha256
FROM documents LEFT JOIN dr USING (text)
"""

OP2 = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rule, verdict) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
p AS (SELECT rule, verdict, split_part(rule, '/', 1) AS rhost, substr(rule, strpos(rule, '/')) AS rpath FROM r),
m AS (
  SELECT u.page_id, u.host, u.path, max_by(p.rule, length(p.rule)) AS rule, max_by(p.verdict, length(p.rule)) AS verdict
  FROM u LEFT JOIN p ON (u.host = p.rhost OR ends_with(u.host, '.' || p.rhost)) AND starts_with(u.path, p.rpath)
  GROUP BY ALL)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m
"""

OP5 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT doc_id, item_id, i, dw.k FROM dw JOIN bw USING (k, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""

OP8 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1, "op2_url_filter": OP2, "op5_decontaminate": OP5, "op8_exact_dedup": OP8}
