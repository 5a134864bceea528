"""SQL that gives the rows of the registered corpus queries, where SQL can express them."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"


def op1(rules) -> str:
    pairs, fences, checks = [], [], []
    for m in rules.measures:
        value = m.expression.replace(" div ", " // ")
        pairs.append(f"SELECT lang, source, '{m.name}' AS measure, {value} AS v FROM counted WHERE NOT base_failed")
        reach = f"greatest({m.spread} * (q75 - q25), {m.least})"
        fences.append(f"max(CASE WHEN measure = '{m.name}' THEN {'top' if m.top else f'q75 + {reach}'} END) AS high_{m.name}")
        fences.append(f"max(CASE WHEN measure = '{m.name}' THEN q25 - {reach} END) AS low_{m.name}")
        checks.append(f"({value}) <= high_{m.name}" + (f" AND ({value}) >= low_{m.name}" if m.low else ""))

    def quartiles(name: str, columns: str) -> str:
        over = f"PARTITION BY {columns}measure"
        seen = f"sum(n) OVER ({over} ORDER BY cell)"
        rows = f"sum(n) OVER ({over})"
        start = lambda cell: f"(CASE WHEN {cell} < 64 THEN {cell} ELSE ({cell} - ({cell} // 32 - 1) * 32) << ({cell} // 32 - 1)::int END)"
        return f"""{name} AS (SELECT {columns}measure, any_value(r) AS r, min(CASE WHEN 100 * seen >= 25 * r THEN s END) AS q25,
            min(CASE WHEN 100 * seen >= 75 * r THEN s END) AS q75, min(CASE WHEN 1000 * seen >= 999 * r THEN e END) AS top
          FROM (SELECT {columns}measure, {seen} AS seen, {rows} AS r, {start("cell")} AS s, {start("(cell + 1)")} - 1 AS e
                FROM (SELECT {columns}measure, cell, sum(n)::bigint AS n FROM cells GROUP BY ALL)) GROUP BY ALL)"""

    pick = lambda q: (
        f"CASE WHEN o.r >= {rules.min_rows} THEN o.{q} WHEN l.r >= {rules.min_rows} THEN l.{q} ELSE a.{q} END AS {q}")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{WORD}') AS ws FROM d),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '{WORD}') GROUP BY rid),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY rid, tri) AS n FROM tri) WHERE n >= 2),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM twice GROUP BY rid),
base AS (SELECT w.rid, doc_id, lang, source, len(ws)::bigint AS n_words, length(array_to_string(ws, ''))::bigint AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols, coalesce(n_lines, 0) AS n_lines,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM w LEFT JOIN lines USING (rid) LEFT JOIN rep USING (rid)),
counted AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM base),
measures AS ({" UNION ALL ".join(pairs)}),
cells AS (SELECT lang, source, measure,
    greatest(length(bin(v)) - 6, 0) * 32 + (v >> greatest(length(bin(v)) - 6, 0)::int) AS cell, count(*) AS n
  FROM measures GROUP BY ALL),
{quartiles("own", "lang, source, ")},
{quartiles("by_lang", "lang, ")},
{quartiles("by_all", "")},
chosen AS (SELECT o.lang, o.source, o.measure, {pick("q25")}, {pick("q75")}, {pick("top")}
  FROM own o JOIN by_lang l ON o.measure = l.measure AND o.lang IS NOT DISTINCT FROM l.lang JOIN by_all a ON o.measure = a.measure),
fences AS (SELECT lang, source, {", ".join(fences)} FROM chosen GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce({" AND ".join(checks)}, false) AS kept
FROM counted c LEFT JOIN fences f ON c.lang IS NOT DISTINCT FROM f.lang AND c.source IS NOT DISTINCT FROM f.source
"""


OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, coalesce(doc_id <> last, false) AS dropped FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY rid
"""


def op4(rules: list[tuple[str, str, str]]) -> str:
    from vigil.llm.url_filters import CANONICAL_HREF, CANONICAL_TAG, REFRESH_TAG, REFRESH_URL

    listed = ", ".join(f"('{h}', '{p}', '{d}')" for h, p, d in rules)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    url = r"'^(?s)(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?'"

    def node(column: str) -> str:
        part = lambda g: f"coalesce(regexp_extract({column}, {url}, {g}), '')"
        return f"nullif({lower.format(part(2))} || {part(3)} || {part(4)}, '')"

    q = lambda pattern: "'" + pattern.replace(r"\"", '"').replace("'", "''") + "'"
    target = lambda tag, inner: f"regexp_extract(regexp_extract(html, {q(tag)}, 0), {q(inner)}, 1)"
    return rf"""
WITH RECURSIVE rules(h, p, d) AS (VALUES {listed}),
raw AS (SELECT url, unnest([{target(CANONICAL_TAG, CANONICAL_HREF)}, {target(REFRESH_TAG, REFRESH_URL)}]) AS t FROM pages),
full_links AS (SELECT url, CASE WHEN t LIKE '//%' THEN regexp_extract(url, {url}, 1) || ':' || t
    WHEN t LIKE '/%' THEN regexp_extract(url, {url}, 1) || '://' || {lower.format(f"regexp_extract(url, {url}, 2)")} || t
    ELSE t END AS t FROM raw WHERE t <> ''),
links AS (SELECT DISTINCT a, b FROM (SELECT {node("url")} AS a, {node("t")} AS b FROM full_links) WHERE a <> b),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
placed AS (SELECT page_id, {lower.format(f"coalesce(regexp_extract(url, {url}, 2), '')")} AS host,
    coalesce(regexp_extract(url, {url}, 3), '') AS path, {node("url")} AS node FROM pages),
places AS (SELECT host, path FROM placed UNION
    SELECT regexp_extract(a, '^[^/?]*', 0), regexp_extract(a, '^[^/?]*([^?]*)', 1) FROM sym),
best AS (SELECT host, path, max_by(h || p, length(h || p)) AS rule, max_by(d, length(h || p)) AS d
  FROM places JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY host, path),
bad AS (SELECT DISTINCT reach.a AS node FROM reach JOIN best ON best.host = regexp_extract(reach.b, '^[^/?]*', 0)
    AND best.path = regexp_extract(reach.b, '^[^/?]*([^?]*)', 1) WHERE best.d = 'block')
SELECT page_id, placed.host, placed.path, best.rule,
  coalesce(best.d, CASE WHEN bad.node IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM placed LEFT JOIN best USING (host, path) LEFT JOIN bad USING (node)
"""


OP6 = r"""
WITH t AS (SELECT conv_id, role, text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
lasts AS (SELECT conv_id, max(i) FILTER (role = 'assistant') AS li FROM t GROUP BY conv_id),
replies AS (SELECT t.conv_id, coalesce(text, '') AS text FROM t JOIN lasts ON t.conv_id = lasts.conv_id AND i = li),
swaps AS (SELECT l.conv_id, li, CASE WHEN li IS NULL THEN NULL ELSE coalesce(n.conv_id, p.conv_id) END AS reply_id,
    coalesce(n.text, p.text, '') AS reply
  FROM lasts l LEFT JOIN replies n ON n.conv_id = l.conv_id + 1 LEFT JOIN replies p ON p.conv_id = l.conv_id - 1),
sides AS (SELECT conv_id, i, true AS chosen, role, text FROM t
  UNION ALL SELECT t.conv_id, i, false, role, CASE WHEN i = li THEN reply ELSE text END FROM t JOIN swaps USING (conv_id)),
common AS (SELECT t.conv_id, reply_id, coalesce(min(i) FILTER (i = li AND text IS DISTINCT FROM reply) - 1, max(i)) AS k
  FROM t JOIN swaps USING (conv_id) GROUP BY ALL),
written AS (SELECT s.*, reply_id, k, '<|' || coalesce(role, '') || '|>' || chr(10) AS head, coalesce(text, '') || '<|end|>' || chr(10) AS body
  FROM sides s JOIN common USING (conv_id)),
marked AS (SELECT *, CASE WHEN i > k AND role = 'assistant' THEN (stop - length(body))::bigint || '-' || stop::bigint END AS span
  FROM (SELECT *, sum(CASE WHEN i > k THEN length(head) + length(body) ELSE 0 END) OVER (PARTITION BY conv_id, chosen ORDER BY i) AS stop
    FROM written))
SELECT conv_id, any_value(reply_id) AS reply_id, max(k)::bigint AS n_common,
  sha256(coalesce(string_agg(head || body, '' ORDER BY i) FILTER (chosen AND i <= k), '')) AS prompt_sha256,
  sha256(coalesce(string_agg(head || body, '' ORDER BY i) FILTER (chosen AND i > k), '')) AS chosen_sha256,
  sha256(coalesce(string_agg(head || body, '' ORDER BY i) FILTER (NOT chosen AND i > k), '')) AS rejected_sha256,
  coalesce(string_agg(span, ' ' ORDER BY i) FILTER (chosen), '') AS chosen_mask,
  coalesce(string_agg(span, ' ' ORDER BY i) FILTER (NOT chosen), '') AS rejected_mask
FROM marked GROUP BY conv_id
"""


#: Letters cut by checksum; words one edit apart are equal, or one is the other, after one letter is taken out.
OP12 = r"""
WITH RECURSIVE d AS (SELECT coalesce(doc_id::varchar, '') AS id, coalesce(text, '') AS t FROM documents),
runs AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all(translate(t,
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM d)
  WHERE length(w) >= 6 GROUP BY id, w),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 9), lambda c, k: CASE WHEN k = 0 THEN c
    WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM range(0, 256) r(i))),
summed AS (SELECT w, n, xor(4294967295, list_reduce(list_transform(range(1, 2 * strlen(id || ':' || w), 2),
    lambda i: ('0x' || substr(hex(id || ':' || w), i, 2))::bigint), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295)) AS h
  FROM runs, crc),
cut AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) ELSE w END AS word, n
  FROM summed),
words AS MATERIALIZED (SELECT word, sum(n)::bigint AS n FROM cut WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
less AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min({'less': -near_n, 'near': near}) AS best FROM pairs GROUP BY word),
formed AS MATERIALIZED (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 5 * n THEN best.near END AS form,
    CASE WHEN -best.less >= 5 * n THEN -best.less END AS form_n FROM words LEFT JOIN best USING (word)),
steps(word, stop, k) AS (SELECT word, word, 0 FROM formed
  UNION ALL SELECT steps.word, formed.form, k + 1 FROM steps JOIN formed ON steps.stop = formed.word WHERE formed.form IS NOT NULL)
SELECT word, form, max_by(stop, k) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n
FROM formed JOIN steps USING (word) GROUP BY word, form
"""


def op11(options) -> str:
    """The patterns as the contract gives them; spans and neighbourhoods by plain joins over whole texts."""
    found = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    word = r"[\p{L}\p{N}]+"
    matched = " UNION ALL ".join(
        f"SELECT t, {i} AS rank, '{k}' AS kind, regexp_extract_all(t, '{p}') AS vs, string_split_regex(t, '{p}') AS gs FROM texts"
        for i, (k, p) in enumerate(found.items()))

    def words(text: str) -> str:
        return f"regexp_extract_all({text}, '{word}') AS ws, string_split_regex({text}, '{word}') AS gs"

    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
texts AS MATERIALIZED (SELECT t, count(*) AS copies FROM d GROUP BY t),
matched AS ({matched}),
each_one AS (SELECT t, rank, kind, i, vs[i] AS v, gs[i] AS g FROM (SELECT *, unnest(range(1, len(vs) + 1)) AS i FROM matched)),
placed AS (SELECT *, s + length(v) AS e, regexp_replace(v, '[^0-9]', '', 'g') AS digits FROM (
  SELECT *, sum(length(g) + length(v)) OVER (PARTITION BY t, rank ORDER BY i) - length(v) AS s FROM each_one)),
chains AS (SELECT *, coalesce(lag(e) OVER w, 0) AS prior, coalesce(lead(s) OVER w, length(t)) AS next
  FROM placed WHERE kind <> 'card' OR length(digits) BETWEEN 12 AND 19 WINDOW w AS (PARTITION BY t, rank ORDER BY s)),
base AS MATERIALIZED (SELECT *, CASE kind WHEN 'email' THEN ['email ' || lower(v), 'email group ' || lower(split_part(v, '@', 2))]
    WHEN 'ip' THEN ['ip ' || v, 'ip group ' || split_part(v, '.', 1) || '.' || split_part(v, '.', 2)]
    WHEN 'card' THEN ['card ' || digits, 'card group ' || left(digits, 6)]
    ELSE ['phone ' || digits, 'phone group ' || left(digits, length(digits) - 7)] END AS entities
  FROM chains WHERE CASE kind WHEN 'email' THEN true
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3
      AND coalesce(try_cast(ltrim(x, '0') AS int), 0) <= 255))
    WHEN 'card' THEN list_sum(list_transform(range(1, length(digits) + 1), lambda i: CASE WHEN i % 2 = 1 THEN digits[-i]::int
      WHEN digits[-i]::int > 4 THEN 2 * digits[-i]::int - 9 ELSE 2 * digits[-i]::int END)) % 10 = 0
    ELSE length(digits) BETWEEN 9 AND 15 END),
sides AS (SELECT t, entities, greatest(prior, s - {options.reach}) AS a, s AS z, s - prior > {options.reach} AS cut_a, false AS cut_z FROM base
  UNION ALL SELECT t, entities, e, least(next, e + {options.reach}), false, next - e > {options.reach} FROM base),
side_words AS (SELECT *, {words("substr(t, a::int + 1, (z - a)::int)")} FROM sides),
side_each AS (SELECT t, entities, a, z, cut_a, cut_z, ws[i] AS w,
    a + sum(length(gs[i]) + length(ws[i])) OVER (PARTITION BY t, entities, a, z, cut_a, cut_z ORDER BY i) AS e
  FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT DISTINCT * FROM side_words))),
near_all AS (SELECT DISTINCT t, unnest(entities) AS entity, lower(w) AS term, e - length(w) AS s, e FROM side_each
  WHERE NOT (cut_a AND e - length(w) = a) AND NOT (cut_z AND e = z)),
near AS MATERIALIZED (SELECT n.*, copies FROM near_all n JOIN texts USING (t)
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.t = n.t AND b.s < n.e AND b.e > n.s)),
counts AS MATERIALIZED (SELECT lower(w) AS term, sum(copies) AS n FROM (SELECT copies, unnest(regexp_extract_all(t, '{word}')) AS w FROM texts) GROUP BY 1),
around AS (SELECT entity, -ln(sum(copies) / (SELECT sum(n) FROM counts)) AS information FROM near GROUP BY entity),
pairs AS (SELECT entity, term, sum(copies) AS together FROM near GROUP BY entity, term HAVING count(DISTINCT t) >= {options.texts}),
revealed AS (SELECT entity, term, 1 + ln(least(1.0, together / n)) / information AS share FROM pairs JOIN around USING (entity) JOIN counts USING (term)
  WHERE information > 0 AND 1 + ln(least(1.0, together / n)) / information >= {options.generalise}),
told AS MATERIALIZED (SELECT t, term, max(share) AS share FROM near JOIN revealed USING (entity, term) GROUP BY t, term),
all_words AS (SELECT t, {words("t")} FROM (SELECT DISTINCT t FROM told)),
word_places AS (SELECT t, w, lower(w) AS term, e - length(w) AS s, e FROM (SELECT t, ws[i] AS w,
    sum(length(gs[i]) + length(ws[i])) OVER (PARTITION BY t ORDER BY i) AS e FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM all_words))),
added AS (SELECT p.t, s, e, CASE WHEN share >= {options.remove} THEN 5 ELSE 4 END AS rank,
    CASE WHEN share >= {options.remove} THEN 'removed' ELSE 'generalised' END AS kind,
    CASE WHEN share >= {options.remove} THEN '' WHEN regexp_matches(w, '^\p{{N}}+$') THEN '[number]' WHEN regexp_matches(w, '^\p{{Lu}}') THEN '[name]'
      ELSE '[word]' END AS put
  FROM word_places p JOIN told USING (t, term) WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.t = p.t AND b.s < p.e AND b.e > p.s)),
spans AS MATERIALIZED (SELECT t, s, e, rank, kind, '[' || kind || ']' AS put FROM base UNION ALL SELECT t, s, e, rank, kind, put FROM added),
lists AS (SELECT t, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in found)},
    coalesce(string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' ORDER BY s, rank) FILTER (rank < 4), '') AS base,
    string_agg(kind || ':' || s::bigint || ':' || e::bigint, ',' ORDER BY s, rank) AS spans FROM spans GROUP BY t),
cuts AS (SELECT *, coalesce(max(e) OVER (PARTITION BY t ORDER BY s, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS past FROM spans),
clean AS (SELECT t, string_agg(substr(t, past::int + 1, greatest(s - past, 0)::int) || CASE WHEN past > s THEN '' ELSE put END, '' ORDER BY s, rank)
    || substr(t, max(e)::int + 1) AS clean FROM cuts GROUP BY t)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(coalesce(clean, t)) AS clean_sha256
FROM d LEFT JOIN lists USING (t) LEFT JOIN clean USING (t)
"""
