"""DuckDB SQL of the queries in ``arbora.llm.queries``, over whole tables."""

def shares(level: str, parent: str, name: str, nodes: str) -> str:
    """CTEs that share the budget of each ``parent`` among ``nodes(parent, name, cap, w, budget)``."""
    return f"""
{level}a AS (SELECT *, coalesce(sum(cap) OVER o, 0) cb, sum(w) OVER p - coalesce(sum(w) OVER o, 0) wl FROM ({nodes})
  WINDOW p AS (PARTITION BY {parent}), o AS (PARTITION BY {parent} ORDER BY cap::DOUBLE / w, {name}
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{level}b AS (SELECT *, cap::HUGEINT * wl <= (budget - cb)::HUGEINT * w AS is_full FROM {level}a),
{level}c AS (SELECT *, budget - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER p rest,
  sum(CASE WHEN is_full THEN 0 ELSE w END) OVER p ws FROM {level}b WINDOW p AS (PARTITION BY {parent})),
{level}d AS (SELECT *, CASE WHEN is_full THEN cap ELSE (w::HUGEINT * rest::HUGEINT) // nullif(ws, 0)::HUGEINT END part
  FROM {level}c),
{level} AS (SELECT * REPLACE ((part + CASE WHEN NOT is_full AND rank <= lost THEN 1 ELSE 0 END)::BIGINT AS budget) FROM
  (SELECT *, budget - sum(part) OVER (PARTITION BY {parent}) lost,
   sum(CASE WHEN is_full THEN 0 ELSE 1 END) OVER (PARTITION BY {parent} ORDER BY {name}) rank FROM {level}d))"""


DOMAIN_NODES = """SELECT 0 r, d, sum(cap)::BIGINT cap,
  CASE d WHEN 'web' THEN 5 WHEN 'news' THEN 3 WHEN 'books' THEN 2 ELSE 1 END w,
  (SELECT sum(tokens)::BIGINT FROM leaf) budget FROM leaf GROUP BY d"""
LANG_NODES = """SELECT d, l, sum(leaf.cap)::BIGINT cap,
  CASE l WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END w,
  any_value(x.budget) budget FROM leaf JOIN x USING (d) GROUP BY d, l"""
SOURCE_NODES = """SELECT d, l, s, leaf.cap, leaf.w, leaf.tokens, y.budget FROM leaf JOIN y USING (d, l)"""

# The table ``mixed`` from a table ``input`` with the columns of documents.
MIXED = rf"""
t AS (SELECT *, coalesce(lang, '') l, coalesce(source, '') s,
  CASE TRY_CAST(regexp_extract(coalesce(source, ''), '(\d+)$', 1) AS BIGINT) % 3
    WHEN 0 THEN 'web' WHEN 1 THEN 'news' WHEN 2 THEN 'books' ELSE '' END d,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT n FROM input),
leaf AS (SELECT d, l, s, sum(n)::BIGINT tokens, 2 * sum(n)::BIGINT cap, 1 w FROM t GROUP BY ALL),
{shares("x", "r", "d", DOMAIN_NODES)},
{shares("y", "d", "l", LANG_NODES)},
{shares("z", "d, l", "s", SOURCE_NODES)},
e AS (SELECT t.*, unnest(range(0, budget // tokens + CASE WHEN budget % tokens > 0 THEN 1 ELSE 0 END)) epoch, budget,
  tokens FROM t JOIN z USING (d, l, s) WHERE budget > 0),
f AS (SELECT *, CASE WHEN epoch < budget // tokens THEN tokens ELSE budget % tokens END room,
  coalesce(sum(n) OVER (PARTITION BY d, l, s, epoch ORDER BY md5('7:' || epoch || ':' || doc_id), n
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) start FROM e),
mixed AS (SELECT *, CASE WHEN epoch < budget // tokens THEN n ELSE least(n, room - start) END::BIGINT used
  FROM f WHERE start < room OR epoch < budget // tokens)"""

OP1 = f"""
WITH input AS (SELECT * FROM documents), {MIXED}
SELECT doc_id, d AS domain, l AS lang, s AS source, epoch::BIGINT epoch, n n_tokens, used tokens_used FROM mixed
"""

OP2 = r"""
WITH w AS (SELECT doc_id, generate_subscripts(ws, 1) i, unnest(ws) w FROM
      (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws FROM documents)),
g AS (SELECT doc_id, i, w, string_agg(w, ' ') OVER s g, count(*) OVER s n
      FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)),
r AS (SELECT doc_id, i, n = 20 AND row_number() OVER (PARTITION BY n = 20, md5(g) ORDER BY doc_id, i) > 1 again FROM g),
c AS (SELECT doc_id, i, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i
      ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) gone FROM r),
k AS (SELECT w.doc_id, count(*) n_words, count(*) FILTER (gone) n_removed,
      string_agg(w, ' ' ORDER BY i) FILTER (NOT gone) kept FROM w JOIN c USING (doc_id, i) GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT n_words, coalesce(n_removed, 0)::BIGINT n_removed,
  sha256(coalesce(kept, '')) kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""

OP5 = r"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) n, sha256(coalesce(html, '')) d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) ELSE page_id END f FROM p)
SELECT page_id, n::BIGINT payload_bytes, d payload_digest,
  CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END record_type,
  CASE WHEN f <> page_id THEN f END refers_to, NULL::VARCHAR problem
FROM f
"""

OP6 = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') t FROM documents),
w AS (SELECT doc_id, generate_subscripts(ws, 1) i, unnest(ws) w FROM
      (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws FROM d)),
g AS (SELECT doc_id, i, w || ' ' || lead(w) OVER s || ' ' || lead(w, 2) OVER s AS g
      FROM w WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) n FROM g WHERE g IS NOT NULL)
      WHERE n > 1),
c AS (SELECT doc_id, count(*) n FROM (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) p FROM r) GROUP BY 1),
l AS (SELECT doc_id, count(*) n_lines, count(*) - count(DISTINCT l) n_dup FROM
      (SELECT doc_id, unnest(string_split(t, chr(10))) l FROM d)
      WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) n_words,
      length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols,
      coalesce(n_dup, 0) n_dup_lines, coalesce(n_lines, 0) n_lines, coalesce(c.n, 0) n_repeat_words
      FROM d LEFT JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines AS rule_failed
      FROM b),
h AS (SELECT source, count(*) host_docs, sum(rule_failed::INT)::BIGINT host_failed FROM f GROUP BY 1),
p AS (SELECT avg(host_failed / host_docs) a, var_pop(host_failed / host_docs) v FROM h),
q AS (SELECT a, CASE WHEN v > 0 THEN least(10000.0, greatest(2.0, a * (1 - a) / v - 1)) ELSE 10000.0 END k FROM p),
x AS (SELECT h.*, (host_failed + a * k) / (host_docs + k) > 0.5 AS host_bad FROM h, q)
SELECT f.doc_id, n_words::BIGINT n_words, word_chars::BIGINT word_chars, n_symbols::BIGINT n_symbols,
  n_dup_lines::BIGINT n_dup_lines, n_repeat_words::BIGINT n_repeat_words, base_failed,
  NOT base_failed AND NOT host_bad AS kept, host_docs, host_failed, host_bad
FROM f JOIN x ON f.source IS NOT DISTINCT FROM x.source
"""

OP7 = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) chars,
           sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) s FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY s ORDER BY chars DESC, doc_id) keep_id,
  count(*) OVER (PARTITION BY s) group_size,
  doc_id = first_value(doc_id) OVER (PARTITION BY s ORDER BY chars DESC, doc_id) kept, s text_sha256
FROM n
"""

OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
  list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, vec_id AS negative_id, score AS negative_score,
  row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM p JOIN s USING (anchor_id) WHERE NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
# CRC-32 of ASCII text: eight shifts per byte, with the reversed polynomial.
CRC32 = """xor(list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT), lambda a, b:
  list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
  lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END), 4294967295::BIGINT),
  4294967295::BIGINT)"""
CONV_KEY = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"

OP13 = rf"""
WITH RECURSIVE
h AS (SELECT *, {CRC32.format(CONV_KEY)} % 20 AS h FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g')
    ELSE coalesce(text, ' ') END AS text,
  unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) FROM h WHERE h <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i
  FROM damaged),
marked AS (SELECT *, rtrim(text, {SPACES}) AS ended,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM numbered),
r AS (SELECT conv_id, turn, i, role, text, left(role, 1) AS c, CASE WHEN ended = '' THEN 'b' WHEN again THEN 'd'
  WHEN right(ended, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault FROM marked),
pairs AS (SELECT conv_id, c || lead(c) OVER (PARTITION BY conv_id ORDER BY i) AS pair FROM r),
facts AS (SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
  count(*) FILTER (fault = 't') AS truncated FROM r GROUP BY 1),
bad AS (SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY 1),
move(p, c, q) AS (VALUES ('0', 's', 's'), ('0', 'u', 'u'), ('s', 'u', 'u'), ('a', 'u', 'u'), ('u', 'a', 'a')),
ins(p, q, ic, ia) AS (SELECT p, p, 0, '' FROM (VALUES ('0'), ('s'), ('u'), ('a')) t(p)
  UNION ALL SELECT p, q, 2, 'I' FROM move WHERE c <> 's'
  UNION ALL VALUES ('0', 'a', 4, 'II'), ('s', 'a', 4, 'II')),
edit AS (SELECT conv_id, i, p, p AS q, 3 AS ec, 'D' AS ea FROM r, (VALUES ('0'), ('s'), ('u'), ('a')) t(p)
  UNION ALL SELECT conv_id, i, p, q, (fault = 't')::INT, 'K' FROM r JOIN move USING (c) WHERE fault IN ('t', '-')
  UNION ALL SELECT conv_id, i, p, q, 2 + (fault = 't')::INT, 'R' FROM r, move
    WHERE fault IN ('t', '-') AND move.c <> 's'),
dp(conv_id, i, q, cost, audit) AS (
  SELECT conv_id, 0::BIGINT, '0', 0, '' FROM facts
  UNION ALL
  SELECT d.conv_id, d.i + 1, edit.q, d.cost + ic + ec AS cost, d.audit || ia || ea AS audit
  FROM dp d JOIN ins ON d.q = ins.p
  JOIN edit ON edit.conv_id IS NOT DISTINCT FROM d.conv_id AND edit.i = d.i + 1 AND edit.p = ins.q
  QUALIFY row_number() OVER (PARTITION BY d.conv_id, edit.q ORDER BY d.cost + ic + ec, d.audit || ia || ea) = 1),
ended AS (SELECT d.conv_id, d.cost + ic AS cost, d.audit || ia AS audit FROM dp d
  JOIN facts f ON f.conv_id IS NOT DISTINCT FROM d.conv_id AND f.n = d.i JOIN ins ON d.q = ins.p
  WHERE ins.q IN ('0', 'a')
  QUALIFY row_number() OVER (PARTITION BY d.conv_id ORDER BY d.cost + ic, d.audit || ia) = 1),
letters AS (SELECT conv_id, audit, generate_subscripts(string_split(audit, ''), 1) AS k,
  unnest(string_split(audit, '')) AS l FROM ended),
places AS (SELECT *, count(*) FILTER (l <> 'I') OVER w AS i,
  count(*) FILTER (l <> 'D') OVER (PARTITION BY conv_id) - count(*) FILTER (l <> 'D') OVER w AS after
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
lines AS (SELECT p.conv_id, k, CASE WHEN l = 'K' THEN r.role WHEN after % 2 = 0 THEN 'assistant' ELSE 'user' END
  || ':' || CASE WHEN l = 'I' THEN '' ELSE r.text END AS line
  FROM places p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i AND l <> 'I' WHERE l <> 'D'),
texts AS (SELECT conv_id, string_agg(line, chr(10) ORDER BY k) AS t FROM lines GROUP BY 1),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
  sha256(coalesce(t, '')) AS repaired_sha256
FROM every e LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN bad b ON b.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN ended x ON x.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""

ORACLES: dict[str, str] = {
    "op1_mixing": OP1,
    "op2_substring_dedup": OP2,
    "op5_warc": OP5,
    "op6_host_rules": OP6,
    "op7_exact_dedup": OP7,
    "op12_hard_negatives": OP12,
    "op13_conversation_repair": OP13,
}
