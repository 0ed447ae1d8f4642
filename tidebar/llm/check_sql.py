"""DuckDB SQL that must give the rows of the queries. Fingerprints (XXH64) and token ids are not in SQL, so op8, op10
and the pipeline have none."""

from __future__ import annotations

from tidebar.llm.line_templates import LEVELS
from tidebar.llm.pii import KINDS
from tidebar.llm.secret_links import BREAK_PLAIN, ENDPOINT, ID, NAMED, PARTS, REACH, SECRET, SECRET_NAMES, VALUE
from tidebar.llm.token_rollup import PATTERNS

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

def level_sql(i: int) -> str:
    """One level of the template tree: from r{i} (leaf, line, lines, toks) what the templates take, g{i}, and what goes down, r{i + 1}."""
    return f"""
x{i} AS (SELECT leaf, line, lines, unnest(range(len(toks))) AS pos, unnest(toks) AS token FROM r{i}),
y{i} AS (SELECT leaf, pos, token, sum(lines) AS c FROM x{i} GROUP BY ALL),
z{i} AS (SELECT leaf, pos, token AS top FROM y{i} QUALIFY row_number() OVER (PARTITION BY leaf, pos ORDER BY c DESC, token DESC) = 1),
b{i} AS MATERIALIZED (SELECT leaf, line, count(*) FILTER (token = top) - 3 >= (count(*) - 3) * 0.7::DOUBLE AS fits, min(pos) FILTER (token <> top) AS away FROM x{i} JOIN z{i} USING (leaf, pos) GROUP BY ALL),
g{i} AS (SELECT line, '{i}' || leaf AS family FROM b{i} WHERE fits),
q{i} AS (SELECT b{i}.leaf || chr(1) || away || chr(1) || toks[away + 1] AS leaf, line, lines, toks FROM b{i} JOIN r{i} USING (leaf, line) WHERE NOT fits),
r{i + 1} AS MATERIALIZED (SELECT * FROM q{i} WHERE leaf IN (SELECT leaf FROM q{i} GROUP BY leaf HAVING count(*) > 1 AND sum(lines) >= 5)),"""


LINES = rf"""
WITH d AS (SELECT doc_id, text, coalesce(doc_id, 9223372036854775807) AS did FROM documents),
s AS (SELECT DISTINCT did, text, string_split(text, chr(10)) AS ls FROM d WHERE text IS NOT NULL),
l AS (SELECT did, text, unnest(range(len(ls))) AS no, regexp_replace(unnest(ls), '[0-9]+', '0', 'g') AS line FROM s),
k AS (SELECT did, text, no, line, regexp_extract_all(line, '{WORD}') AS toks, regexp_extract(line, '{WORD}(?:{GAP}{WORD}){{0,2}}') AS lead FROM l),
f AS MATERIALIZED (SELECT *, len(toks) AS n FROM k WHERE len(toks) > 0),
u AS MATERIALIZED (SELECT n, lead, line, any_value(toks) AS toks, count(*) AS lines, count(DISTINCT (did, text)) AS docs, min((did, no)) AS first FROM f GROUP BY n, lead, line),
eq AS (SELECT line, first FROM u WHERE docs >= CASE WHEN n < 4 THEN 20 ELSE 2 END),
v AS (SELECT n || chr(1) || lead AS leaf, line, lines, toks FROM u WHERE n >= 4),
r0 AS MATERIALIZED (SELECT * FROM v WHERE leaf IN (SELECT leaf FROM v GROUP BY leaf HAVING count(*) > 1 AND sum(lines) >= 5)),
{"".join(level_sql(i) for i in range(LEVELS))}
g AS MATERIALIZED ({" UNION ALL ".join(f"SELECT * FROM g{i}" for i in range(LEVELS))}),
m AS MATERIALIZED (SELECT f.did, f.text, f.no, g.family FROM f JOIN g USING (line)),
fr AS (SELECT family, min((did, no)) AS first FROM m GROUP BY family HAVING count(DISTINCT (did, text)) >= 5),
lost AS (SELECT did, text, no FROM f JOIN eq USING (line) WHERE (did, no) <> first UNION SELECT did, text, no FROM m JOIN fr USING (family) WHERE (did, no) <> first),
o AS (SELECT did, text, list(no) AS gone FROM lost GROUP BY ALL)
SELECT d.doc_id, CASE WHEN o.gone IS NULL THEN d.text ELSE
         array_to_string([q[1] FOR q IN list_zip(string_split(d.text, chr(10)), range(len(string_split(d.text, chr(10))))) IF NOT list_contains(o.gone, q[2])], chr(10)) END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines,
       coalesce(len(o.gone), 0)::BIGINT AS n_dropped
FROM d LEFT JOIN o ON d.did = o.did AND d.text = o.text
"""

QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 1)) AS i, unnest([ws[j] || ' ' || ws[j + 1] || ' ' || ws[j + 2] FOR j IN range(1, len(ws) - 1)]) AS x FROM w WHERE len(ws) > 2),
h AS (SELECT rid, i FROM g QUALIFY count(*) OVER (PARTITION BY rid, x) > 1),
p AS (SELECT rid, count(DISTINCT i + o) AS n FROM h, range(3) AS r(o) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT rid, count(*) AS n_lines, count(DISTINCT line) AS kinds FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY rid),
a AS (SELECT w.doc_id, w.rid, len(ws) AS n_words, coalesce(list_sum([length(x) FOR x IN ws]), 0) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        length(text) - length(replace(text, '!', '')) AS shouts,
        len([x FOR x IN ws IF regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')]) AS uppers FROM w),
b AS (SELECT a.*, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_lines - m.kinds, 0) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
      FROM a LEFT JOIN p USING (rid) LEFT JOIN m USING (rid)),
c AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 5 * shouts > n_words OR 2 * uppers > n_words
            OR NOT (2 * n_words <= word_chars AND word_chars <= 15 * n_words) OR 2 * n_dup_lines > n_lines) AS kept
FROM c
"""

MIX = rf"""
WITH q AS (SELECT doc_id, 0.5 + 1.5 * avg(quality::DOUBLE) AS w FROM labels GROUP BY doc_id),
b AS (SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '{WORD}')) AS size,
        -ln((('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
          / greatest(coalesce(q.w, 1.0), 0.001)::DOUBLE AS key
      FROM documents d LEFT JOIN q USING (doc_id)),
k AS (SELECT *, least(floor((1.0::DOUBLE - exp(-key)) * 1024)::INT, 1023) AS bucket FROM b),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM k GROUP BY source),
v AS (SELECT *, [5.0, 2.0, 1.0][((r - 1) % 3 + 1)::INT]::DOUBLE AS w, (source_size * 3)::DOUBLE AS cap FROM s),
lv AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS level
       FROM v WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM lv),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
f AS (SELECT *, greatest(0, floor(target - epochs * source_size + 0.5))::BIGINT AS rest FROM e),
x AS (SELECT k.*, f.source_size, f.target, f.epochs, f.rest,
        sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - k.size AS before
      FROM k JOIN f ON k.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, source, size::BIGINT AS size, source_size, round(target, 3) AS target,
       (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM x
"""

TOPK = """
WITH v AS (SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum([z[1] * z[2] FOR z IN list_zip(a.v, b.v)])::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM p QUALIFY rank <= 20
"""

REPEATS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws, row_number() OVER () AS rid FROM documents),
g AS (SELECT rid, doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest([array_to_string(ws[j:j + 12], ' ') FOR j IN range(1, len(ws) - 11)]) AS x FROM d WHERE len(ws) >= 13),
h AS (SELECT rid, i, doc_id > min(doc_id) OVER (PARTITION BY x) AS hit FROM g),
p AS (SELECT rid, list(DISTINCT i + o) AS gone FROM h, range(13) AS r(o) WHERE hit GROUP BY rid)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE [z[1] FOR z IN list_zip(ws, range(1, len(ws) + 1)) IF NOT list_contains(gone, z[2])] END, ' ')) AS kept_sha256
FROM d LEFT JOIN p USING (rid)
"""



def tokens_sql(text: str, version: str) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({text}, '{p}'))" for p in PATTERNS[version]) + ")"


V1, V2 = PATTERNS
ROLLUP = rf"""
WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS a, regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g') AS b FROM documents),
c AS (SELECT doc_id, source, lang, '{V1}' AS tokenizer, {tokens_sql("a", V1)} AS n, {tokens_sql("b", V1)} AS revised FROM t
      UNION ALL SELECT doc_id, source, lang, '{V2}', {tokens_sql("a", V2)}, {tokens_sql("b", V2)} FROM t),
m AS (SELECT doc_id, max(toxic) AS toxic, min(quality) AS quality FROM labels GROUP BY doc_id),
r AS (SELECT source, lang, tokenizer, CASE WHEN quality = 0 THEN revised ELSE n END AS n FROM c LEFT JOIN m USING (doc_id) WHERE toxic IS DISTINCT FROM 1)
SELECT source, lang, tokenizer, count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_tokens FROM r GROUP BY ALL
"""


def luhn_sql(d: str) -> str:
    part = "CASE WHEN z[2] % 2 = 1 THEN z[1]::INT WHEN z[1]::INT > 4 THEN 2 * z[1]::INT - 9 ELSE 2 * z[1]::INT END"
    return f"list_sum([{part} FOR z IN list_zip(string_split(reverse({d}), ''), range(1, length({d}) + 1))]) % 10 = 0"


def mod97_sql(c: str) -> str:
    turned = f"(substr({c}, 5) || substr({c}, 1, 4))"
    wide = f"array_to_string([CASE WHEN x < 'A' THEN x ELSE (ascii(x) - 55)::VARCHAR END FOR x IN string_split({turned}, '')], '')"
    return f"list_reduce([x::INT FOR x IN string_split({wide}, '')], lambda a, x: (a * 10 + x) % 97) = 1"


DIGITS = "regexp_replace(hit, '[^0-9]', '', 'g')"
EDGES = "NOT regexp_matches(before, '[A-Za-z0-9]$') AND NOT regexp_matches(after, '^[A-Za-z0-9]')"
VALID = {
    "email": "true",
    "ip": "list_bool_and([length(ltrim(x, '0')) < 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') <= '255') FOR x IN string_split(hit, '.')])",
    "card": f"length({DIGITS}) BETWEEN 16 AND 19 AND {luhn_sql(DIGITS)}",
    "phone": f"length({DIGITS}) BETWEEN 8 AND 15",
    "iban": f"{EDGES} AND {mod97_sql("replace(hit, ' ', '')")}",
    "ssn": f"{EDGES} AND NOT regexp_matches(hit, '^(?:000|666|9)')",
}


def pii_sql() -> str:
    found = []
    for i, k in enumerate(KINDS):
        score = f"round({k.prior + 0.5 * k.checksum}::DOUBLE + CASE WHEN regexp_matches(lower(before), '{k.context}') THEN 0.3::DOUBLE ELSE 0::DOUBLE END, 2)"
        keep = "true" if k.base else f"{score} >= 0.6::DOUBLE"
        found.append(f"""
          SELECT rid, {i} AS kind, '{k.name}' AS name, start, stop, {score} AS score FROM (
            SELECT rid, h[i] AS hit, list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN h[1:i - 1]]), 0) AS start,
              list_sum([length(x) FOR x IN p[1:i]]) + list_sum([length(x) FOR x IN h[1:i]]) AS stop, right(p[i], 40) AS before, left(p[i + 1], 1) AS after
            FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (
              SELECT rid, regexp_extract_all(text, '{k.plain}') AS h, regexp_split_to_array(text, '{k.plain}') AS p FROM d)))
          WHERE {VALID[k.name]} AND {keep}""")
    base = len([k for k in KINDS if k.base])
    counts = ", ".join(f"count(*) FILTER (kind = {i})::BIGINT AS n_{k.name}" for i, k in enumerate(KINDS) if k.base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
s AS ({" UNION ALL ".join(found)}),
a AS (SELECT rid, {counts},
        string_agg(name || ':' || start || ':' || stop, ',' ORDER BY kind, start) FILTER (kind < {base}) AS base,
        string_agg(name || ':' || start || ':' || stop, ',' ORDER BY kind, start) AS spans,
        count(*) FILTER (kind >= {base})::BIGINT AS n_added, max(score) AS top_score FROM s GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS if k.base)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added, top_score
FROM d LEFT JOIN a USING (rid)
"""


TAIL = "CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END"
URLS = rf"""
WITH RECURSIVE u AS (SELECT page_id, url, {TAIL} AS tail FROM pages),
h AS (SELECT page_id, tail, coalesce(translate(regexp_extract(tail, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(tail, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
k AS (SELECT *, list_sort(list_distinct(
        ['h:' || regexp_replace(x, '[0-9]+', '0', 'g') FOR x IN string_split(host, '.') IF x <> '']
        || ['p:' || regexp_replace(x, '[0-9]+', '0', 'g') FOR x IN string_split(path, '/') IF x <> '']
        || ['q:' || regexp_replace(y, '[0-9]+', '0', 'g') FOR y IN [regexp_extract(z, '^[^=]*') FOR z IN string_split(coalesce(regexp_extract(tail, '^[^?#]*\?([^#]*)', 1), ''), '&')] IF y <> ''])) AS tokens FROM h),
g AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS v(verdict, rhost, rpath)),
f AS (SELECT page_id, arg_max((verdict, rhost || rpath), length(rhost) * 1000 + length(rpath)) AS best
      FROM k JOIN g ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
t AS (SELECT tokens, f.best[1] = 'block' AS bad, row_number() OVER () AS rid FROM k JOIN f USING (page_id) WHERE len(tokens) > 0),
x AS (SELECT rid, bad, unnest(tokens) AS token FROM t),
c AS (SELECT rid, bad, [token] AS ts, token AS last FROM x UNION ALL SELECT c.rid, c.bad, list_append(c.ts, x.token), x.token FROM c JOIN x ON c.rid = x.rid AND x.token > c.last),
r AS (SELECT ts FROM c GROUP BY ts HAVING count(*) FILTER (bad) >= ceil(0.005::DOUBLE * (SELECT count(*) FROM t)) AND count(*) FILTER (bad) >= 0.8::DOUBLE * count(*) AND count(*) FILTER (bad) > 0),
m AS (SELECT DISTINCT page_id FROM k JOIN r ON list_has_all(k.tokens, r.ts))
SELECT k.page_id, k.host, k.path, f.best[2] AS rule,
       CASE WHEN f.best IS NOT NULL THEN f.best[1] WHEN m.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM k LEFT JOIN f USING (page_id) LEFT JOIN m USING (page_id)
"""

SECRET_VALID = {
    "assign": rf"length(regexp_extract(hit, '^(?:{SECRET_NAMES}){NAMED}({VALUE}+)', 1)) >= 8".replace("\"']", "\"'']"),
    "blob": "length(hit) <= 64 AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[0-9]')",
}


def secrets_sql() -> str:
    kinds = [(i, k.name, k.plain, SECRET_VALID.get(k.name, "true")) for i, k in enumerate(PARTS)] + [(len(PARTS), "break", BREAK_PLAIN, "true")]
    found = [
        f"""
          SELECT rid, {i} AS kind, '{name}' AS name, start, stop FROM (
            SELECT rid, h[i] AS hit, list_sum([length(x) FOR x IN p[1:i]]) + coalesce(list_sum([length(x) FOR x IN h[1:i - 1]]), 0) AS start,
              list_sum([length(x) FOR x IN p[1:i]]) + list_sum([length(x) FOR x IN h[1:i]]) AS stop
            FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM (
              SELECT rid, regexp_extract_all(text, '{plain.replace("'", "''")}') AS h, regexp_split_to_array(text, '{plain.replace("'", "''")}') AS p FROM d)))
          WHERE {valid}"""
        for i, name, plain, valid in kinds
    ]
    of = lambda role: ", ".join(str(i) for i, k in enumerate(PARTS) if k.role == role)
    weak, base = ([i for i, k in enumerate(PARTS) if k.weak is w] for w in (True, False))
    listed = lambda ks: ", ".join(map(str, ks))
    near = lambda role: f"EXISTS (FROM c AS o WHERE o.rid = c.rid AND o.scope = c.scope AND o.kind IN ({of(role)}) AND abs(o.start - c.start) <= {REACH})"
    weak_of = lambda role: f"kind IN ({listed([i for i in weak if PARTS[i].role == role])})"
    counts = ", ".join(f"count(*) FILTER (kind = {i})::BIGINT AS n_{PARTS[i].name}" for i in base)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
s AS MATERIALIZED ({" UNION ALL ".join(found)}),
b AS (SELECT s.*, (SELECT count(*) FROM s AS o WHERE o.rid = s.rid AND o.kind = {len(PARTS)} AND o.start < s.start) AS scope FROM s WHERE kind < {len(PARTS)}),
c AS MATERIALIZED (SELECT * FROM b WHERE NOT (kind IN ({listed([i for i in weak if PARTS[i].role == SECRET])}) AND EXISTS (
       FROM b AS o WHERE o.rid = b.rid AND o.kind IN ({listed(base)}) AND o.start <= b.start AND o.stop > b.start))),
l AS (SELECT *, {near(ID)} AS has_id, {near(SECRET)} AS has_secret FROM c),
k AS (SELECT *, kind IN ({listed(base)}) OR ({weak_of(ID)} AND has_secret) OR ({weak_of(SECRET)} AND has_id) OR ({weak_of(ENDPOINT)} AND has_id AND has_secret) AS stays FROM l),
a AS (SELECT rid, {counts},
        string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (kind IN ({listed(base)})) AS base,
        string_agg(name || ':' || start || ':' || stop, ',' ORDER BY start, kind) FILTER (stays) AS spans,
        count(*) FILTER (stays AND kind IN ({listed(weak)}))::BIGINT AS n_added, count(*) FILTER (kind IN ({of(SECRET)}) AND has_id)::BIGINT AS n_linked FROM k GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{PARTS[i].name}, 0) AS n_{PARTS[i].name}" for i in base)}, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_added, 0) AS n_added, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN a USING (rid)
"""


SPELLING = r"""
WITH RECURSIVE t AS (SELECT [list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)] AS tab),
w AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
r AS (SELECT id, run, count(*) AS n FROM w WHERE length(run) >= 6 GROUP BY ALL),
h AS (SELECT *, xor(list_reduce([4294967295] || flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, (unicode(c) - 64)::BIGINT] END FOR c IN string_split(id || ':' || run, '')]),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM r, t),
m AS (SELECT n, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word FROM h),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
e AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
x AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS cut FROM e),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
      UNION SELECT x.word, v.word, v.n FROM x JOIN v ON x.cut = v.word
      UNION SELECT v.word, x.word, x.n FROM x JOIN v ON x.cut = v.word),
g AS (SELECT word, count(*) AS n_near, max(near_n) AS top FROM p GROUP BY word),
q AS (SELECT p.word, min(p.near) AS near FROM p JOIN g USING (word) WHERE p.near_n = g.top GROUP BY p.word),
f AS MATERIALIZED (SELECT v.word, v.n, coalesce(g.n_near, 0)::BIGINT AS n_near, CASE WHEN g.top >= 5 * v.n THEN q.near END AS form, CASE WHEN g.top >= 5 * v.n THEN g.top END AS form_n
      FROM v LEFT JOIN g USING (word) LEFT JOIN q USING (word)),
s AS (SELECT word, word AS last, 0 AS steps FROM f UNION ALL SELECT s.word, f.form, steps + 1 FROM s JOIN f ON s.last = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, arg_max(s.last, s.steps) AS root, f.n, f.n_near, f.form_n FROM f JOIN s USING (word) GROUP BY ALL
"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RANKED = rf"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS a, 'abcdefghijklmnopqrstuvwxyz' AS b),
i AS (SELECT row_number() OVER () AS iid, item_id, list_distinct(regexp_extract_all(translate(text, a, b), '{TERM}')) AS ts FROM benchmark, low),
it AS (SELECT iid, item_id, unnest(ts) AS term FROM i),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(text, a, b), '{TERM}') AS ts FROM documents, low),
c AS (SELECT rid, doc_id, len(ts)::BIGINT AS n, ts FROM d WHERE len(ts) > 0),
nl AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM c),
tf AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ts) AS term FROM c) WHERE term IN (SELECT term FROM it) GROUP BY ALL),
df AS (SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, nl GROUP BY term, nd),
p AS (SELECT tf.rid, c.doc_id, tf.term, df.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * c.n * nd) // l))) AS s FROM tf JOIN c USING (rid) JOIN df USING (term), nl),
z AS (SELECT it.iid, it.item_id, p.rid, p.doc_id, sum(p.s)::BIGINT AS score FROM it JOIN p USING (term) GROUP BY ALL HAVING sum(p.s) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score FROM z QUALIFY rank <= 50
"""

SQL: dict[str, str] = {
    "op1_line_templates": LINES, "op2_quality_rules": QUALITY, "op3_source_mix": MIX, "op4_topk_search": TOPK,
    "op5_substring_dedup": REPEATS, "op6_token_rollup": ROLLUP, "op7_pii": pii_sql(), "op9_url_rules": URLS,
    "op11_secret_links": secrets_sql(), "op12_spelling_variants": SPELLING, "op13_ranked_search": RANKED,
}
