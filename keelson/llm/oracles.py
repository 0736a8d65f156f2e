"""DuckDB SQL for the queries of this subpackage that SQL can express on whole tables.

Written from the contracts alone: windows and pairs are compared as text, nothing is hashed
or sampled. Quadratic in places; meant for the small tables.
"""

from __future__ import annotations

_ASSIGN = """(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?[ ]*[:=][ ]*["'']?([A-Za-z0-9+/_.=-]+)"""

def _crc(text: str) -> str:
    """CRC-32 of ASCII text, bit by bit."""
    bits = "list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    return f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda r, b: {bits}), 4294967295)"


def _repair() -> str:
    """Backwards over each conversation: for each state the least (cost, edits) and what they make of the rest."""
    plus = lambda letter, cost, line, rest: f"{{'c': {rest}.c + {cost}, 'a': '{letter}' || {rest}.a, 'r': {line} || {rest}.r}}"
    least = lambda *x: f"list_min([{', '.join(x)}])"
    after = {"z": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    role = {"u": "user", "a": "assistant"}
    never = "{'c': 1000000000, 'a': '', 'r': ''}"
    step = {}
    for q, to in after.items():
        ways = [plus("D", 2, "''", f"f.{q}")]
        for k, t in to.items():
            ways.append(f"CASE WHEN x.initial = '{k}' AND NOT x.must THEN {plus('K', 'x.more', 'x.line', f'f.{t}')} ELSE {never} END")
            if k in role:
                ways.append(f"CASE WHEN NOT x.must THEN {plus('R', 'x.more + 1', f"chr(10) || '{role[k]}:' || x.text", f'f.{t}')} ELSE {never} END")
        ways.append(f"CASE WHEN x.initial = '' AND NOT x.must THEN {plus('K', 'x.more', 'x.line', f'f.{q}')} ELSE {never} END")
        step[q] = least(*ways)
    add = lambda r, rest: plus("I", 5, f"chr(10) || '{role[r]}:'", rest)
    settle = lambda source: f"SELECT conv_id, i, {least('z', add('u', 'u'))} AS z, {least('s', add('u', 'u'))} AS s, u, {least('a', add('u', 'u'))} AS a FROM (SELECT conv_id, i, z, s, {least('u', add('a', 'a'))} AS u, a FROM ({source}))"
    here = "{'c': 0, 'a': '', 'r': ''}"
    return f"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations),
d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM k, unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS t(copy)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
w AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault,
  left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS was FROM o),
x AS (SELECT conv_id, i, initial, text, chr(10) || role || ':' || text AS line, fault IN ('b', 'd') AS must, CASE fault WHEN 't' THEN 5 ELSE 0 END AS more FROM w),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (was IS NOT NULL AND was || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM w GROUP BY conv_id),
c AS (SELECT DISTINCT conv_id, coalesce(n, 0) AS n FROM k LEFT JOIN g USING (conv_id)),
f(conv_id, i, z, s, u, a) AS ({settle(f"SELECT conv_id, n AS i, {here} AS z, {never} AS s, {never} AS u, {here} AS a FROM c")}
  UNION ALL {settle(f"SELECT f.conv_id, f.i - 1 AS i, " + ", ".join(f"{step[q]} AS {q}" for q in after) + " FROM f JOIN x ON x.conv_id IS NOT DISTINCT FROM f.conv_id AND x.i = f.i")})
SELECT f.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(f.z.c AS BIGINT) AS cost, f.z.a AS audit, sha256(substr(f.z.r, 2)) AS repaired_sha256
FROM f LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM f.conv_id WHERE f.i = 0
"""


SQL: dict[str, str] = {
    "base_secret_spans": f"""
WITH p(no, kind, pattern) AS (VALUES (1, 'assign', '{_ASSIGN}'), (2, 'access', 'AKIA[A-Z0-9]+'), (3, 'hex', '[0-9a-f]+')),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT row, text, '{_ASSIGN}' AS pattern, 1 AS no, regexp_extract_all(text, '{_ASSIGN}') AS m, string_split_regex(text, '{_ASSIGN}') AS g FROM d
  UNION ALL SELECT row, text, '', 2, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), string_split_regex(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT row, text, '', 3, regexp_extract_all(text, '[0-9a-f]+'), string_split_regex(text, '[0-9a-f]+') FROM d),
x AS (SELECT row, no, k, m[k] AS hit, length(m[k]) AS size, length(g[k]) AS gap FROM a, unnest(range(1, len(m) + 1)) AS t(k)),
y AS (SELECT *, sum(gap + size) OVER (PARTITION BY row, no ORDER BY k) AS stop FROM x),
z AS (SELECT row, no, CAST(stop - size AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM y
  WHERE CASE no WHEN 1 THEN length(regexp_extract(hit, '{_ASSIGN}', 1)) >= 6 WHEN 2 THEN size >= 20 ELSE size >= 24 END),
s AS (SELECT row, count(*) FILTER (no = 1) AS n_assign, count(*) FILTER (no = 2) AS n_access, count(*) FILTER (no = 3) AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) AS spans FROM z JOIN p USING (no) GROUP BY row)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN s USING (row)
""",
    "op2_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[p : p + 4], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 3, 2))) AS t(p) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reached)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
""",
    "op3_mixing_sources": r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
  md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest FROM documents),
s AS (SELECT source, sum(n_tokens) AS tokens, count(*) AS n FROM w GROUP BY source),
t AS (SELECT CAST(sum(tokens) AS DOUBLE) AS total, CAST(count(*) FILTER (tokens > 0) AS DOUBLE) AS m FROM s),
f(low, high) AS (SELECT 0, 1048577 UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END FROM (
    SELECT f.low, f.high, (f.low + f.high) // 2 AS mid, (SELECT ln(sum(pow(tokens / total, x))) - sum(pow(tokens / total, x) * x * ln(tokens / total)) / sum(pow(tokens / total, x)) >= 0.97 * ln(any_value(m))
      FROM s, t, (SELECT ((f.low + f.high) // 2) / 1048576.0::DOUBLE AS x) WHERE tokens > 0) AS ok FROM f WHERE f.high - f.low > 1)),
o(low, high) AS (SELECT -1, 1048576 UNION ALL
  SELECT CASE WHEN ok THEN mid ELSE low END, CASE WHEN ok THEN high ELSE mid END FROM (
    SELECT o.low, o.high, (o.low + o.high) // 2 AS mid, (SELECT max(pow(tokens / total, x) * total / tokens) / sum(pow(tokens / total, x)) > 4.0
      FROM s, t, (SELECT ((o.low + o.high) // 2) / 1048576.0::DOUBLE AS x) WHERE tokens > 0) AS ok FROM o WHERE o.high - o.low > 1)),
x AS (SELECT greatest((SELECT max(low) FROM f), (SELECT max(low) FROM o) + 1) / 1048576.0::DOUBLE AS x),
z AS (SELECT sum(pow(tokens / total, x)) AS z FROM s, t, x WHERE tokens > 0),
p AS (SELECT source, tokens, CAST(ceil(n / 1024.0) AS BIGINT) AS blocks, CASE WHEN tokens > 0 THEN pow(tokens / total, x) / z ELSE 0 END AS weight, total FROM s, t, x, z),
g AS (SELECT *, CAST(floor(weight * total) AS BIGINT) AS goal FROM p),
h AS (SELECT *, CASE WHEN tokens > 0 THEN goal // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN goal % tokens ELSE goal END AS rest FROM g),
b AS (SELECT w.*, h.weight, h.whole, h.rest, CAST('0x' || substr(digest, 1, 12) AS BIGINT) % blocks AS block FROM w JOIN h USING (source))
SELECT doc_id, source, n_tokens, round(weight, 6) AS weight,
  CAST(whole + CASE WHEN sum(n_tokens) OVER (PARTITION BY source ORDER BY block, digest, doc_id, n_tokens ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies,
  block, row_number() OVER (PARTITION BY source, block ORDER BY digest, doc_id, n_tokens) AS place FROM b
""",
    "op5_suffix_array_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, 200 * k AS o, length(h) // 2 AS n, substr(h, CAST(400 * k + 1 AS INT), 498) AS c FROM d, unnest(range(0, length(h) // 400 + 1)) AS t(k)),
w AS (SELECT doc_id, o + j AS p, substr(c, CAST(2 * j + 1 AS INT), 100) AS s FROM c, unnest(range(0, 200)) AS t(j) WHERE o + j <= n - 50),
f AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
g AS (SELECT w.doc_id, w.p, lag(w.p) OVER (PARTITION BY w.doc_id ORDER BY w.p) AS q FROM w JOIN f USING (s) WHERE f.first_id < w.doc_id),
r AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
s AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM r GROUP BY doc_id, run),
k AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS was FROM s),
e AS (SELECT k.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(d.h, CAST(2 * was + 1 AS INT), CAST(2 * (a - was) AS INT)), '' ORDER BY a) AS head, max(b) AS last
  FROM k JOIN d USING (doc_id) GROUP BY k.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last, 0) + 1 AS INT)))) AS kept_sha256
FROM d LEFT JOIN e USING (doc_id)
""",
    "op9_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, p, array_to_string(ws[p : p + 12], ' ') AS s FROM d, unnest(range(1, len(ws) - 11)) AS t(p)),
f AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
g AS (SELECT DISTINCT w.doc_id, w.p + o AS i FROM w JOIN f USING (s), range(0, 13) AS t(o) WHERE f.first_id < w.doc_id),
c AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE [ws[x] for x in range(1, len(ws) + 1) if NOT list_contains(gone, x)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)
""",
    "op11_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT row, doc_id, i, ls[i] AS line, translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d, unnest(range(1, len(ls) + 1)) AS t(i)),
h AS (SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
k AS (SELECT l.*, coalesce(l.doc_id <> h.top, false) AS gone FROM l LEFT JOIN h USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM k GROUP BY row
""",
    "op12_conversation_trie": f"""
WITH k AS (SELECT DISTINCT conv_id AS c, conv_id - conv_id % 5 AS g, {_crc("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, t, size, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, t) - 1 AS p FROM (
  SELECT conv_id AS c, turn, strlen(coalesce(text, '')) AS size, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t FROM conversations)),
b AS (SELECT k.c, 0 AS own, o.p, t, size FROM k JOIN o ON o.c = g WHERE p < h UNION ALL SELECT k.c, 1, o.p, t, size FROM k JOIN o ON o.c = k.c WHERE p >= h),
a AS (SELECT c, row_number() OVER w AS d, string_agg(t, '') OVER w AS path, size FROM b WINDOW w AS (PARTITION BY c ORDER BY own, p)),
m AS (SELECT c, 0 AS d, '' AS path, 0 AS size FROM k UNION ALL SELECT * FROM a),
e AS (SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ends FROM (SELECT c, arg_max(path, d) AS path FROM m GROUP BY c) GROUP BY path),
n AS (SELECT path, d, min(c) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM m GROUP BY path, d),
u AS (SELECT left(path, 32 * (d - 1)) AS path, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
s AS (SELECT left(n.path, 32 * i) AS path, count(*) FILTER (u.path IS NULL) AS n_leaves, sum((n_convs - 1) * size) AS saved_tokens FROM n LEFT JOIN u USING (path), unnest(range(0, d + 1)) AS t(i) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM n LEFT JOIN n q ON n.d > 0 AND q.path = left(n.path, 32 * (n.d - 1)) AND q.d = n.d - 1 LEFT JOIN u ON u.path = n.path JOIN s ON s.path = n.path LEFT JOIN e ON e.path = n.path
""",
    "op13_conversation_repair": _repair(),
}
