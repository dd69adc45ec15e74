"""DuckDB SQL for the queries that SQL can express at a bearable speed."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
w AS (SELECT DISTINCT item, least(len(ws), 10) AS n, array_to_string(ws[i : i + 9], ' ') AS win FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
p AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n),
h AS (SELECT doc_id, i, n, item FROM (SELECT doc_id, i, n, array_to_string(ws[i : i + n - 1], ' ') AS win FROM p) JOIN w USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY doc_id),
j AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN j USING (doc_id)
"""

OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS shingle FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""

_ESCAPED = r"regexp_replace(regexp_replace({}, '(\\*)(<\|(?:turn|text|end)\|>)', '\1\1\\\2', 'g'), '(\\+)$', '\1\1')"

OP8 = rf"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
CAST(sum(len('<|turn|>' || {_ESCAPED.format("role")} || '<|text|>' || {_ESCAPED.format("text")} || '<|end|>' || chr(10))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""

_WORDS = r"[^\x20\x09-\x0D]+"

OP4 = rf"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) AS BIGINT) AS size,
  md5('20|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(source, '') || '|' || md5(coalesce(text, ''))) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST(i % 3 AS INTEGER) + 1] AS weight, 3 * source_size AS bound FROM s),
b AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight, coalesce(sum(bound) OVER o, 0) AS bound_before, coalesce(sum(weight) OVER o, 0) AS weight_before FROM w
  WINDOW o AS (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, bound * (all_weight - weight_before) <= weight * (total - bound_before) AS met FROM b),
n AS (SELECT *, sum(CASE WHEN met THEN bound ELSE 0 END) OVER () AS bound_met, sum(CASE WHEN met THEN weight ELSE 0 END) OVER () AS weight_met FROM m),
t AS (SELECT source, source_size, CASE WHEN met THEN CAST(bound AS DOUBLE) ELSE CAST(weight * (total - bound_met) AS DOUBLE) / CAST(all_weight - weight_met AS DOUBLE) END AS target FROM n),
p AS (SELECT d.*, t.source_size, t.target, CAST(floor(target) AS BIGINT) AS budget, CAST(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target, CAST(whole * size + greatest(0, least(size, budget - whole * source_size - before)) AS BIGINT) AS taken FROM e
"""


def _spans(kind: int, name: str, pattern: str, passes: str, options: str = "''") -> str:
    """Starts are the lengths of the pieces between matches and of the matches before."""
    return rf"""SELECT doc_id, {kind} AS kind, '{name}' AS name, m, CAST(list_sum([length(x) for x in ps[1 : i]]) + coalesce(list_sum([length(x) for x in ms[1 : i - 1]]), 0) AS BIGINT) AS a
FROM (SELECT doc_id, ms, ps, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}', 0, {options}) AS ms, string_split_regex(text, '{pattern}', {options}) AS ps FROM d)) WHERE {passes}"""


_ASSIGN = r"""(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+"""
_VALUE = r"""regexp_extract(m, '^(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?(.*)$', 1, 'is')"""

OP5 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join((
    _spans(0, "assign", _ASSIGN, f"length({_VALUE}) >= 8", "'i'"),
    _spans(1, "access", "AKIA[A-Z0-9]+", "length(m) >= 16"),
    _spans(2, "hex", "[0-9a-f]+", "length(m) >= 32"),
    _spans(3, "private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?", "true"),
    _spans(4, "bearer", r"eyJ[A-Za-z0-9_-]{{8,}}\.eyJ[A-Za-z0-9_-]{{8,}}\.[A-Za-z0-9_-]{{16,}}".replace("{{", "{").replace("}}", "}"), "true"),
    _spans(5, "forge", "gh[pousr]_[A-Za-z0-9]{36,}", "true"),
))}),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg(name || ':' || a || ':' || (a + length(m)), ',' ORDER BY a, kind) FILTER (kind < 3) AS base, string_agg(name || ':' || a || ':' || (a + length(m)), ',' ORDER BY a, kind) AS spans FROM f GROUP BY doc_id)
SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""

OP3 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT doc_id, o, substr(h, 2 * o + 1, 798) AS part FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99, 300)) AS o FROM d WHERE len(h) >= 200)),
p AS (SELECT doc_id, o + x AS i, md5_number(substr(part, 2 * x + 1, 200)) AS string FROM (SELECT doc_id, o, part, unnest(range(0, least(300, len(part) // 2 - 99))) AS x FROM k)),
s AS (SELECT doc_id, i, row_number() OVER (PARTITION BY string ORDER BY doc_id, i) AS r FROM p),
l AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM s WHERE r > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN j IS NULL OR i > j + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l),
q AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b FROM g GROUP BY doc_id, k),
c AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM q GROUP BY doc_id)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(unhex(CASE WHEN starts IS NULL THEN h ELSE array_to_string([substr(h, 2 * (CASE WHEN x = 1 THEN 0 ELSE ends[x - 1] END) + 1, 2 * ((CASE WHEN x > len(starts) THEN len(h) // 2 ELSE starts[x] END) - (CASE WHEN x = 1 THEN 0 ELSE ends[x - 1] END))) for x in range(1, len(starts) + 2)], '') END)) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
"""


def _rounds(n: int) -> str:
    """Lloyd's rounds as common tables: a{r} assigns parts to the entries of b{r}, b{r + 1} has the moved entries."""
    out = []
    for r in range(n + 1):
        apart = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
        out.append(f"a{r} AS MATERIALIZED (SELECT i, part, any_value(x) AS x, CAST(min(d) AS BIGINT) AS d, arg_min(entry, d * 256 + entry) AS entry FROM (SELECT i, p.part, x, entry, {apart} AS d FROM p JOIN b{r} USING (part)) GROUP BY i, part)")
        if r < n:
            sums = f"SELECT part, entry, j, floor(sum(x[j]) / count(*)) AS m FROM (SELECT *, unnest(range(1, len(x) + 1)) AS j FROM a{r}) GROUP BY part, entry, j"
            out.append(f"b{r + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m, c) AS c FROM b{r} LEFT JOIN (SELECT part, entry, list(m ORDER BY j) AS m FROM ({sums}) GROUP BY part, entry) USING (part, entry))")
    return ",\n".join(out)


#: Whole numbers far below 2^53 are exact as doubles.
OP12 = rf"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, x) - 1 AS i, * FROM (SELECT CAST(vec_id AS BIGINT) AS vec_id, label, [floor(1024 * CAST(e AS DOUBLE)) for e in embedding] AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len([1 for e in embedding if e IS NULL OR NOT isfinite(e)]) = 0)),
p AS MATERIALIZED (SELECT i, part, x[part * (len(x) // 4) + 1 : (part + 1) * (len(x) // 4)] AS x FROM v, range(4) AS r(part)),
b0 AS MATERIALIZED (SELECT part, i AS entry, x AS c FROM p WHERE i < 256),
{_rounds(4)},
h AS (SELECT sha256(coalesce(string_agg(array_to_string([CAST(CAST(e AS BIGINT) AS VARCHAR) for e in c], ','), ',' ORDER BY part, entry), '')) AS codebooks_sha256 FROM b4),
f AS (SELECT i, string_agg(printf('%02x', CAST(entry AS BIGINT)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY i)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN f USING (i), h
"""

#: CRC-32 bit by bit; a turn's key is the digest of its role's length, role and text, a prefix the keys of its turns.
OP13 = """
WITH RECURSIVE t AS (SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, list({'k': md5(length(role) || ':' || role || text), 'n': CAST(length(text) AS BIGINT)} ORDER BY turn NULLS FIRST, role, text) AS own FROM t GROUP BY c),
crc(c, b, i, x) AS (SELECT c, CAST(c AS VARCHAR), 0, CAST(4294967295 AS UBIGINT) FROM o
  UNION ALL SELECT c, b, i + 1, xor(y >> 1, CASE WHEN y & 1 = 1 THEN CAST(3988292384 AS UBIGINT) ELSE CAST(0 AS UBIGINT) END) FROM (SELECT *, CASE WHEN i % 8 = 0 THEN xor(x, CAST(ascii(b[i // 8 + 1]) AS UBIGINT)) ELSE x END AS y FROM crc WHERE i < 8 * length(b))),
h AS (SELECT c, CAST(xor(x, CAST(4294967295 AS UBIGINT)) % 6 AS BIGINT) AS h FROM crc WHERE i = 8 * length(b)),
r AS (SELECT o.c, list_concat(coalesce(d.own[1 : h], []), o.own[h + 1 :]) AS s FROM o JOIN h USING (c) LEFT JOIN o AS d ON d.c = o.c - o.c % 100),
v AS (SELECT c, d, len(s) = d AS ends, array_to_string([x.k for x in s[1 : d]], ',') AS p, CASE WHEN d > 0 THEN array_to_string([x.k for x in s[1 : d - 1]], ',') END AS q, CASE WHEN d > 0 THEN s[d].n ELSE 0 END AS chars,
  [array_to_string([x.k for x in s[1 : k]], ',') for k in range(0, d + 1)] AS above FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS (SELECT p, any_value(q) AS q, any_value(above) AS above, min(c) AS conv_id, any_value(d) AS depth, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM v GROUP BY p),
k AS (SELECT q AS p, count(*) AS n_children FROM n GROUP BY q),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (p)),
u AS (SELECT a AS p, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * chars) AS BIGINT) AS saved_tokens FROM (SELECT *, unnest(above) AS a FROM m) GROUP BY a)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves, u.saved_tokens, m.ends_sha256 FROM m JOIN u USING (p) LEFT JOIN m AS up ON up.p = m.q
"""

OP11 = rf"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
w AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d WHERE len(ws) >= 13)),
m AS (SELECT win, min(doc_id) AS home FROM w GROUP BY win HAVING min(doc_id) < max(doc_id)),
x AS (SELECT DISTINCT doc_id, k FROM (SELECT doc_id, unnest(range(i, i + 13)) AS k FROM w JOIN m USING (win) WHERE doc_id > home)),
g AS (SELECT doc_id, count(*) AS n_removed FROM x GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM d) ANTI JOIN x USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""

#: What op6 counts before any learned cutoff.
QUALITY_COUNTS = rf"""
WITH d AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS ws FROM documents),
l AS (SELECT doc_id, [x for x in string_split(text, chr(10)) if regexp_matches(x, '{_WORDS}')] AS lines FROM d),
w AS (SELECT doc_id, i, array_to_string(ws[i : i + 2], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d WHERE len(ws) >= 3)),
r AS (SELECT doc_id, win FROM w GROUP BY 1, 2 HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS k FROM w JOIN r USING (doc_id, win)) GROUP BY 1),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) for x in ws]), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
"""

_ONLY_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum([CASE WHEN (length({_ONLY_DIGITS}) - k) % 2 = 0 THEN CAST({_ONLY_DIGITS}[k] AS BIGINT) WHEN CAST({_ONLY_DIGITS}[k] AS BIGINT) > 4 THEN 2 * CAST({_ONLY_DIGITS}[k] AS BIGINT) - 9 ELSE 2 * CAST({_ONLY_DIGITS}[k] AS BIGINT) END for k in range(1, length({_ONLY_DIGITS}) + 1)]) % 10 = 0"

#: What op9 finds by its fixed patterns.
PERSONAL_DATA_BASE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
f AS ({" UNION ALL ".join((
    _spans(0, "email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    _spans(1, "ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len([x for x in string_split(m, '.') if length(ltrim(x, '0')) > 3 OR CAST('0' || right(x, 3) AS BIGINT) > 255]) = 0"),
    _spans(2, "card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_ONLY_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}"),
    _spans(3, "phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_ONLY_DIGITS}) BETWEEN 10 AND 15"),
))}),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = {k}) AS n_{n}" for k, n in enumerate(("email", "ip", "card", "phone")))}, string_agg(name || ':' || a || ':' || (a + length(m)), ',' ORDER BY a, kind) AS base FROM f GROUP BY doc_id)
SELECT CAST(doc_id AS BIGINT) AS doc_id, {", ".join(f"coalesce(n_{n}, 0) AS n_{n}" for n in ("email", "ip", "card", "phone"))}, sha256(coalesce(base, '')) AS base_sha256 FROM d LEFT JOIN g USING (doc_id)
"""
