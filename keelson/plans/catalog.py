"""The registered queries and the SQL that says what they should return."""

from __future__ import annotations


from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import BINARY_EXTENSIONS, DEFAULT_EXCLUDES, DETECTORS, GENERATED_EXCLUDES, HIGH_ENTROPY, PLACEHOLDERS, Detector, keywords, library
from ..functions import exprs as X
from ..functions.keywords import present
from ..operators import baseline, diff, findings, graph, history, match
from ..sources.tree import decoded
from ..streaming.sessions import latest_per_path, sessions
from . import facts
from .derived import view, with_views
from .facts import Facts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
KEYS = ("file", "line", "column", "detector_id", "secret_type", "severity", "hint", "entropy", "hash16")
EVERYTHING = (*DETECTORS, HIGH_ENTROPY)
MARK = Detector("custom.mark", "Mark", "low", "[=;]")
TOKEN = Detector("custom.token", "Token", "high", '(token = ")([0-9a-f]{40})"', None, 2, keywords=("token",))


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            SQL[key] = with_views(sql)
        return f

    return add


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "v_files")


# --- scans and filters

EXT = "regexp_extract(lower(path), '(\\.[^./]*)$', 1)"


def globs_sql(globs: list[str]) -> str:
    return " OR ".join(f"regexp_matches(path, '{X.glob_regex(g)}')" for g in globs)


@query(f"SELECT path, {EXT} AS ext FROM v_files WHERE {EXT} IN ('.json', '.config', '.xml')")
def scan_ext_filter(spark, sf_dir):
    ext = X.extension(F.col("path"))
    return files(spark, sf_dir).where(ext.isin(".json", ".config", ".xml")).select("path", ext.alias("ext"))


@query(f"SELECT path FROM v_files WHERE ({globs_sql(['src/**/*'])}) AND NOT ({globs_sql([*DEFAULT_EXCLUDES, *GENERATED_EXCLUDES, '**/*9.ini'])})")
def scan_glob_filter(spark, sf_dir):
    return files(spark, sf_dir).where(X.in_scope(F.col("path"), ("src/**/*",), ("**/*9.ini",))).select("path")


@query(f"SELECT path FROM v_files WHERE NOT ({globs_sql(DEFAULT_EXCLUDES)})")
def scan_include_generated(spark, sf_dir):
    return files(spark, sf_dir).where(X.in_scope(F.col("path"), generated=True)).select("path")


@query("SELECT path, size FROM v_files WHERE size <= 400200")
def scan_size_cap(spark, sf_dir):
    return files(spark, sf_dir).where(F.col("size") <= 400200).select("path", "size")


@query(f"SELECT path FROM v_files WHERE {EXT} NOT IN ({', '.join(repr(x) for x in BINARY_EXTENSIONS)})")
def scan_binary_ext(spark, sf_dir):
    return files(spark, sf_dir).where(~X.is_binary_name(F.col("path"))).select("path")


@query("SELECT count(*) AS n, count(*) FILTER (content IS NULL) AS skipped FROM (SELECT CASE WHEN ends_with(path, '.dll') THEN NULL ELSE content END AS content FROM v_files)")
def files_skipped(spark, sf_dir):
    """Libraries get a byte 0, and all texts go through the decoder as bytes."""
    data = F.encode("content", "utf-8")
    rows = files(spark, sf_dir).select(decoded(F.when(F.col("path").endswith(".dll"), F.concat(F.lit(b"\0"), data)).otherwise(data)).alias("content"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("content").isNull()).alias("skipped"))


@query("SELECT path FROM v_files WHERE contains(lower(content), 'akia') OR contains(lower(content), 'ghp_')")
def keyword_prefilter(spark, sf_dir):
    return files(spark, sf_dir).where(F.size(present(F.col("content"), ["AKIA", "ghp_"])) > 0).select("path")


def words_sql(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


@query(f"SELECT path, array_to_string(list_sort([k for k in [{words_sql(facts.KEYWORDS)}] if contains(lower(content), k)]), ',') AS keywords FROM v_files")
def present_keywords(spark, sf_dir):
    return files(spark, sf_dir).select("path", F.array_join(present(F.col("content"), keywords(EVERYTHING)), ",").alias("keywords"))


def fits_sql(f: Facts, path: str = "path", content: str = "content", check_extension: bool = True) -> str:
    ext = f"regexp_extract(lower({path}), '(\\.[^./]*)$', 1) IN ({words_sql(f.extensions.split())})" if f.extensions and check_extension else "true"
    kw = " OR ".join(f"contains(lower({content}), '{k}')" for k in f.keywords.split("\n") if k) or "true"
    return f"{ext} AND ({kw})"


def may_match_sql() -> str:
    return " UNION ALL ".join(f"SELECT path AS file, '{f.id}' AS detector_id FROM v_files WHERE {fits_sql(f)}" for f in (*facts.FACTS, facts.HIGH_ENTROPY))


@query(may_match_sql())
def detector_theta_join(spark, sf_dir):
    return match.theta(files(spark, sf_dir), EVERYTHING, spark)


# --- detectors

ENTROPY_SQL = "(SELECT coalesce(-sum(p * log2(p)), 0.0) FROM (SELECT count(*) / length(v)::DOUBLE AS p FROM unnest(string_split(v, '')) AS t(c) GROUP BY c))"
PLACEHOLDER_SQL = "(trim(trim(v), '\"''') = '' OR lower(trim(trim(v), '\"''')) IN ({}) OR regexp_matches(trim(trim(v), '\"'''), '^[*xX_.?]*$'))".format(words_sql(PLACEHOLDERS))


def detect_sql(f: Facts, table: str = "v_files", path: str = "path", content: str = "content", extra: str = "", check_extension: bool = True) -> str:
    """All matches of one detector, by positions of whole matches and lengths of what precedes the value."""
    rx = f.regex.replace("'", "''")
    value = f"regexp_extract_all({content}, '{rx}', {f.group('value') or 0})"
    before = f"[length(x) for x in regexp_extract_all({content}, '{rx}', 1)]" if f.groups else "[0 for x in m]"
    key = f"regexp_extract_all({content}, '{rx}', {f.group('key')})" if f.group("key") else "[NULL for x in m]"
    keep = f"AND NOT {PLACEHOLDER_SQL}" if f.reject_placeholders else ""
    order = facts.FACTS.index(f) if f in facts.FACTS else len(facts.FACTS) if f == facts.HIGH_ENTROPY else 0
    return f"""SELECT {extra} file, '{f.id}' AS detector_id, '{f.secret_type}' AS secret_type, '{f.severity}' AS severity, {order} AS detector_order, off, pre,
 CAST(length(pre) - length(replace(pre, chr(10), '')) + 1 AS INT) AS line, CAST(length(pre) - coalesce(length(pre) - nullif(instr(reverse(pre), chr(10)), 0) + 1, 0) + 1 AS INT) AS "column",
 CASE WHEN k IS NOT NULL AND regexp_matches(k, '^[A-Za-z0-9_.:-]+$') AND NOT (length(v) >= 4 AND EXISTS (SELECT 1 FROM range(1, length(v) - 2) AS w(i) WHERE contains(k || '=***', substr(v, i::INT, 4)))) THEN k || '=***' ELSE '{f.secret_type}=***' END AS hint,
 {ENTROPY_SQL} AS e, upper(substr(sha256(v), 1, 32)) AS hash16
FROM (SELECT *, c[: off] AS pre FROM (SELECT {extra} file, c, v, k, list_sum([length(g) for g in gaps[1 : i]]) + coalesce(list_sum([length(x) for x in m[1 : i - 1]]), 0) + b AS off
 FROM (SELECT {extra} file, c, m, gaps, unnest(vs) AS v, unnest(ks) AS k, unnest(bs) AS b, unnest(range(1, len(m) + 1)) AS i
 FROM (SELECT *, {before.replace(content, 'c')} AS bs, {key.replace(content, 'c')} AS ks FROM (SELECT {extra} {path} AS file, {content} AS c, regexp_extract_all({content}, '{rx}') AS m, {value} AS vs, string_split_regex({content}, '{rx}') AS gaps FROM {table} WHERE {fits_sql(f, path, content, check_extension)})))))
WHERE v <> '' {keep} AND e >= {f.min_entropy}"""


OUT_SQL = 'file, line, "column", detector_id, secret_type, severity, hint, round(e + 1e-12, 1) AS entropy, hash16'
for _d, _f in zip(EVERYTHING, (*facts.FACTS, facts.HIGH_ENTROPY), strict=True):

    def _detect(spark, sf_dir, d=_d):
        m = match.matches(files(spark, sf_dir), (d,))
        return m.withColumn("entropy", X.round_entropy(F.col("entropy_exact"))).select(*KEYS)

    query(f"SELECT {OUT_SQL} FROM ({detect_sql(_f)})", f"detect_{_f.id.replace('.', '_')}")(_detect)


@query(f"SELECT {OUT_SQL} FROM ({detect_sql(facts.TOKEN, 'documents', 'cast(doc_id AS varchar)', 'text')})")
def detect_custom_token(spark, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    m = match.matches(texts, (TOKEN,))
    return m.withColumn("entropy", X.round_entropy(F.col("entropy_exact"))).select(*KEYS)


ALL_SQL = " UNION ALL ".join(f"({detect_sql(f)})" for f in facts.FACTS)
RANK_SQL = "CASE severity WHEN 'critical' THEN 3 WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"


def tree(spark: SparkSession, sf_dir: str, detectors=DETECTORS) -> DataFrame:
    return findings.working_tree(files(spark, sf_dir), detectors, keep_keys=True)


@query(f"SELECT {OUT_SQL} FROM ({ALL_SQL})")
def findings_all(spark, sf_dir):
    return tree(spark, sf_dir).select(*KEYS)


@query(f"SELECT {OUT_SQL} FROM ({ALL_SQL}) WHERE {RANK_SQL} >= 2")
def findings_min_severity(spark, sf_dir):
    return tree(spark, sf_dir, library(least="high")).select(*KEYS)


@query(f"SELECT severity, count(*) AS n FROM ({ALL_SQL}) GROUP BY severity")
def summary_by_severity(spark, sf_dir):
    return findings.summary(tree(spark, sf_dir))


@query(f"SELECT file, count(*) AS n, string_agg(line || ':' || \"column\" || ':' || secret_type, ',' ORDER BY line, \"column\", secret_type) AS places FROM ({ALL_SQL}) GROUP BY file")
def by_file(spark, sf_dir):
    return findings.by_file(tree(spark, sf_dir))


@query(f"SELECT DISTINCT secret_type FROM ({ALL_SQL})")
def rules_distinct(spark, sf_dir):
    return findings.rules(tree(spark, sf_dir))


@query(f"SELECT {OUT_SQL} FROM ({ALL_SQL}) ORDER BY file, line, \"column\", detector_order, off")
def report_sorted(spark, sf_dir):
    return tree(spark, sf_dir).orderBy(*findings.ORDER).select(*KEYS)


@query("SELECT path FROM v_files ORDER BY path LIMIT 100")
def max_files(spark, sf_dir):
    return findings.limited(files(spark, sf_dir).select("path"), 100)[0]


@query(f"SELECT count(*) > 0 AS found FROM ({ALL_SQL})")
def any_finding(spark, sf_dir):
    return tree(spark, sf_dir).limit(1).agg((F.count("*") > 0).alias("found"))


KNOWN_SQL = f"SELECT file, line, secret_type, hint FROM ({ALL_SQL}) WHERE line % 3 = 0"


@query(f"SELECT {OUT_SQL} FROM ({ALL_SQL}) f WHERE NOT EXISTS (SELECT 1 FROM ({KNOWN_SQL}) b WHERE b.file = f.file AND b.line = f.line AND b.secret_type = f.secret_type AND b.hint = f.hint)")
def baseline_filter(spark, sf_dir):
    found = tree(spark, sf_dir)
    return baseline.suppress(found, found.where("line % 3 = 0")).select(*KEYS)


@query(f"SELECT DISTINCT file, line, secret_type, hint FROM ({ALL_SQL})")
def baseline_write(spark, sf_dir):
    return baseline.entries(tree(spark, sf_dir))


# --- scalars

SAMPLES = ["changeme", " ChangeMe ", '"placeholder"', "***", "xxXX", "", "   ", "<secret>", "p@ssw0rd!real", "aaaaaaaa", "aB3$kP9!xQ2#", "Token=***x", "abc"]


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    extra = spark.createDataFrame([(x,) for x in SAMPLES], "v string")
    return part.select(F.col("p_name").alias("v")).unionByName(part.select(F.md5("p_name").alias("v"))).unionByName(extra)


SAMPLES_SQL = "(SELECT p_name AS v FROM part UNION ALL SELECT md5(p_name) FROM part UNION ALL SELECT unnest([{}]))".format(words_sql(SAMPLES))


@query(f"SELECT v, {PLACEHOLDER_SQL} AS placeholder FROM {SAMPLES_SQL}")
def placeholder_filter(spark, sf_dir):
    return samples(spark, sf_dir).select("v", X.is_placeholder(F.col("v")).alias("placeholder"))


@query(f"SELECT v, CASE WHEN v = '' THEN 0.0 ELSE round({ENTROPY_SQL} + 1e-12, 1) END AS entropy FROM {SAMPLES_SQL}")
def entropy(spark, sf_dir):
    return samples(spark, sf_dir).select("v", X.round_entropy(X.entropy(F.col("v"))).alias("entropy"))


@query(f"SELECT v, upper(substr(sha256(v), 1, 32)) AS hash16 FROM {SAMPLES_SQL}")
def hash16(spark, sf_dir):
    return samples(spark, sf_dir).select("v", X.hash16(F.col("v")).alias("hash16"))


@query("SELECT path, CAST(place AS INT) AS place, CAST(length(p) - length(replace(p, chr(10), '')) + 1 AS INT) AS line, CAST(length(p) - coalesce(length(p) - nullif(instr(reverse(p), chr(10)), 0) + 1, 0) + 1 AS INT) AS \"column\" FROM (SELECT path, place, content[: place - 1] AS p FROM (SELECT path, content, unnest(range(1, length(content) + 1)) AS place FROM v_files) WHERE content[place] IN ('=', ';'))")
def line_column(spark, sf_dir):
    """Line and column of every = and ; of whole files, as the scan finds places."""
    found = match.occurrences(match.extracted(F.col("content"), *match.of_detectors(F.lit(0), (MARK,))))
    marks = files(spark, sf_dir).where(F.length("content") > 0).select("path", F.explode(found).alias("m"))
    return marks.select("path", (F.col("m.offset") + 1).cast("int").alias("place"), F.col("m.line").cast("int").alias("line"), F.col("m.column").cast("int").alias("column"))


@query(
    "SELECT v, CASE WHEN regexp_matches(v, '^[A-Za-z0-9_.:-]+$') AND NOT (length(w) >= 4 AND EXISTS (SELECT 1 FROM range(1, length(w) - 2) AS t(i) WHERE contains(v || '=***', substr(w, i::INT, 4)))) THEN v || '=***' ELSE 'ApiKey=***' END AS hint"
    f" FROM (SELECT v, CASE WHEN length(v) % 3 = 0 THEN substr(v, 2, 5) WHEN length(v) % 3 = 1 THEN '=***' ELSE md5(v) END AS w FROM {SAMPLES_SQL})"
)
def hint(spark, sf_dir):
    """Each sample as the key of a value that is part of it, that shows in the mask, or that has nothing to do with it."""
    v = F.col("v")
    value = F.when(F.length(v) % 3 == 0, F.substring(v, 2, 5)).when(F.length(v) % 3 == 1, "=***").otherwise(F.md5(v))
    return samples(spark, sf_dir).select("v", X.hint(F.lit("ApiKey"), v, value).alias("hint"))


HOMES = "CASE c_custkey % 5 WHEN 0 THEN concat('/Users/u', cast(c_custkey AS string), '/a/b.cs') WHEN 1 THEN concat('/home/u', cast(c_custkey AS string)) WHEN 2 THEN concat('C:', chr(92), 'Users', chr(92), 'u', chr(92), 'a', chr(92), 'b.cs') WHEN 3 THEN 'src/a.json' ELSE '/HOME/x/y' END"


@query(f"SELECT p AS path, CASE WHEN regexp_matches(p, '(?i)^(/Users/[^/\\\\]+|/home/[^/\\\\]+|[A-Z]:\\\\Users\\\\[^/\\\\]+)') THEN rtrim('~/' || replace(ltrim(regexp_replace(p, '(?i)^(/Users/[^/\\\\]+|/home/[^/\\\\]+|[A-Z]:\\\\Users\\\\[^/\\\\]+)', ''), '/' || chr(92)), chr(92), '/'), '/') ELSE p END AS redacted FROM (SELECT {HOMES} AS p FROM customer)")
def redact_home(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("customer")
    return spark.sql(f"SELECT {HOMES} AS path FROM customer").withColumn("redacted", X.redact_home(F.col("path")))


@query(f"SELECT severity, CASE WHEN severity IN ('critical', 'high') THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END AS level, count(*) AS n FROM ({ALL_SQL}) GROUP BY ALL")
def sarif_level(spark, sf_dir):
    return tree(spark, sf_dir).groupBy("severity", X.sarif_level(F.col("severity")).alias("level")).agg(F.count("*").alias("n"))


# --- commit graph

REACH_SQL = "r(sha) AS (SELECT sha FROM v_refs {where} UNION SELECT e.parent FROM r JOIN v_edges e ON e.sha = r.sha)"


def graph_views(spark, sf_dir):
    return tuple(view(spark, sf_dir, n) for n in ("v_commits", "v_edges", "v_refs"))


@query("SELECT DISTINCT sha FROM v_refs")
def tips_union(spark, sf_dir):
    return graph.tips(graph_views(spark, sf_dir)[2])


@query(f"WITH RECURSIVE {REACH_SQL.format(where='')} SELECT sha FROM r")
def reachable(spark, sf_dir):
    _, edge, refs = graph_views(spark, sf_dir)
    return graph.closure(graph.tips(refs), edge)


@query(f"WITH RECURSIVE {REACH_SQL.format(where='')} SELECT count(*) AS n FROM r")
def reachable_count(spark, sf_dir):
    _, edge, refs = graph_views(spark, sf_dir)
    return graph.closure(graph.tips(refs), edge).agg(F.countDistinct("sha").alias("n"))


@query("WITH RECURSIVE r(branch, sha) AS (SELECT name, sha FROM v_refs WHERE kind = 'branch' UNION SELECT r.branch, e.parent FROM r JOIN v_edges e ON e.sha = r.sha) SELECT sha, string_agg(branch, ',' ORDER BY branch) AS branches FROM r GROUP BY sha")
def branch_membership(spark, sf_dir):
    _, edge, refs = graph_views(spark, sf_dir)
    return graph.membership(refs, edge).select("sha", F.array_join("branches", ",").alias("branches"))


@query(f"WITH RECURSIVE {REACH_SQL.format(where='')} SELECT c.sha FROM v_commits c WHERE c.sha NOT IN (SELECT sha FROM r)")
def unreachable(spark, sf_dir):
    commits, edge, refs = graph_views(spark, sf_dir)
    return graph.unreachable(commits, graph.closure(graph.tips(refs), edge)).select("sha")


@query("SELECT sha, author_when FROM v_commits ORDER BY author_when DESC, sha LIMIT 100")
def recent_commits_topk(spark, sf_dir):
    return graph.most_recent(graph_views(spark, sf_dir)[0], 100).select("sha", "author_when")


@query(f"WITH RECURSIVE {REACH_SQL.format(where='')} SELECT c.sha, c.author_when FROM v_commits c JOIN r USING (sha) WHERE c.author_when >= TIMESTAMP '1996-01-01 00:00:00'")
def commits_since(spark, sf_dir):
    commits, edge, refs = graph_views(spark, sf_dir)
    return graph.since(commits.join(graph.closure(graph.tips(refs), edge), "sha"), "1996-01-01 00:00:00").select("sha", "author_when")


@query("SELECT sha, parent FROM v_edges WHERE parent_idx = 0")
def first_parent(spark, sf_dir):
    return graph.first_parents(graph_views(spark, sf_dir)[1])


# --- diffs and history

#: Each file of the derived commits adds three lines: two in a row that start after as many empty ones as its number says, and the 20th.
ADDED_SQL = "(SELECT sha, path, status, content, CAST(place AS INT) AS line FROM (SELECT *, unnest([l + 1, l + 2, 20]) AS place FROM (SELECT *, CAST(regexp_extract(path, 'f([0-9]+)', 1) AS INT) AS l FROM v_diffs)))"


@query(f"SELECT sha, path, line, string_split(content, chr(10))[line] AS text FROM {ADDED_SQL}")
def diff_added_lines(spark, sf_dir):
    return diff.added_lines(view(spark, sf_dir, "v_diffs"))


DIFF_MATCH_SQL = " UNION ALL ".join(f"({detect_sql(f, 'v_diffs', 'path', 'content', 'sha, status,')})" for f in facts.FACTS)
SEMI_SQL = f"SELECT m.* FROM ({DIFF_MATCH_SQL}) m JOIN (SELECT DISTINCT sha, path, line FROM {ADDED_SQL}) a ON a.sha = m.sha AND a.path = m.file AND a.line = m.line WHERE m.status <> 'deleted'"


def history_views(spark, sf_dir):
    return (*graph_views(spark, sf_dir), view(spark, sf_dir, "v_diffs"))


@query(f"SELECT sha, file, line, detector_id, hash16 FROM ({SEMI_SQL})")
def added_line_semijoin(spark, sf_dir):
    commits, _, _, diffs = history_views(spark, sf_dir)
    return history.file_matches(commits, diffs, DETECTORS).select("sha", "file", "line", "detector_id", "hash16")


EARLIEST_SQL = f"SELECT * FROM (SELECT s.*, c.author_when, c.author_name, row_number() OVER (PARTITION BY secret_type, hash16 ORDER BY c.author_when, s.sha, file, detector_order, off) AS n FROM ({SEMI_SQL}) s JOIN v_commits c USING (sha)) WHERE n = 1"


@query(f"SELECT secret_type, hash16, sha, file, line FROM ({EARLIEST_SQL})")
def history_dedup_earliest(spark, sf_dir):
    commits, _, _, diffs = history_views(spark, sf_dir)
    found = history.file_matches(commits, diffs, DETECTORS).select("secret_type", "hash16", *history.ORDER, "line")
    return history.earliest(found).select("secret_type", "hash16", "sha", "file", "line")


PRESENT_SQL = " UNION ALL ".join(f"({detect_sql(f)})" for f in facts.FACTS)
FLAG_SQL = f"SELECT e.*, EXISTS (SELECT 1 FROM ({PRESENT_SQL}) p WHERE p.secret_type = e.secret_type AND p.hash16 = e.hash16) AS still_present FROM ({EARLIEST_SQL}) e"


def flagged(spark, sf_dir):
    commits, _, _, diffs = history_views(spark, sf_dir)
    found = history.file_matches(commits, diffs, DETECTORS).select("secret_type", "hash16")
    return history.with_presence(history.earliest(found), tree(spark, sf_dir))


@query(f"SELECT secret_type, hash16, still_present FROM ({FLAG_SQL})")
def still_present(spark, sf_dir):
    return flagged(spark, sf_dir).select("secret_type", "hash16", "still_present")


@query(f"SELECT secret_type, hash16 FROM ({FLAG_SQL}) WHERE still_present")
def still_present_only(spark, sf_dir):
    return history.view(flagged(spark, sf_dir).withColumn("source", F.lit("history")), still_present_only=True).select("secret_type", "hash16")


@query(f"SELECT secret_type, hash16 FROM ({FLAG_SQL}) WHERE NOT still_present")
def removed_only(spark, sf_dir):
    return history.view(flagged(spark, sf_dir).withColumn("source", F.lit("history")), removed_only=True).select("secret_type", "hash16")


MESSAGE_SQL = " UNION ALL ".join(f"({detect_sql(f, 'v_commits', chr(39) + '<commit-message>' + chr(39), 'message', 'sha,', False)})" for f in facts.FACTS)


@query(f"SELECT sha, file, line, \"column\", secret_type, hint, hash16 FROM ({MESSAGE_SQL})")
def commit_message_findings(spark, sf_dir):
    return findings.message_findings(graph_views(spark, sf_dir)[0], DETECTORS).select("sha", "file", "line", "column", "secret_type", "hint", "hash16")


BRANCH_SQL = "b AS (SELECT sha, string_agg(branch, ',' ORDER BY branch) AS branches FROM r GROUP BY sha)"
MESSAGE_FIRST_SQL = f"SELECT * FROM (SELECT m.*, c.author_when, row_number() OVER (PARTITION BY secret_type, hash16 ORDER BY c.author_when, m.sha, detector_order, off) AS n FROM ({MESSAGE_SQL}) m JOIN v_commits c USING (sha)) WHERE n = 1"


@query(
    f"""WITH RECURSIVE r(branch, sha) AS (SELECT name, sha FROM v_refs WHERE kind = 'branch' UNION SELECT r.branch, e.parent FROM r JOIN v_edges e ON e.sha = r.sha), {BRANCH_SQL}
SELECT 'history' AS source, file, line, secret_type, hint, f.sha AS commit_sha, substr(f.sha, 1, 7) AS commit_short, f.author_when AS commit_date, '[redacted]' AS author_name, coalesce(b.branches, '') AS branches, still_present FROM ({FLAG_SQL}) f LEFT JOIN b USING (sha)
UNION ALL SELECT 'commitMessage', file, line, secret_type, hint, sha, substr(sha, 1, 7), author_when, '[redacted]', NULL, NULL FROM ({MESSAGE_FIRST_SQL})"""
)
def history_findings(spark, sf_dir):
    commits, edge, refs, diffs = history_views(spark, sf_dir)
    columns = ("source", "file", "line", "secret_type", "hint", "commit_sha", "commit_short", "commit_date", "author_name", "branches", "still_present")
    found = history.findings(commits, diffs, graph.membership(refs, edge), tree(spark, sf_dir), DETECTORS, columns=columns)
    return findings.redacted(found).withColumn("branches", F.array_join("branches", ","))


# --- watching, as relations

ISLAND_SQL = "SELECT *, sum(CASE WHEN prev IS NULL OR ts > prev + INTERVAL 600 SECOND THEN 1 ELSE 0 END) OVER (ORDER BY ts, path) AS s FROM (SELECT path, ts, lag(ts) OVER (ORDER BY ts, path) AS prev FROM v_changes)"


@query(f"SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS changes, count(DISTINCT lower(path)) AS paths FROM ({ISLAND_SQL}) GROUP BY s")
def watch_debounce_sessions(spark, sf_dir):
    return sessions(view(spark, sf_dir, "v_changes"), "600 seconds")


@query(f"WITH c AS (SELECT path, TIMESTAMP '2024-01-01 00:00:00' + to_microseconds((epoch_us(ts) % 2592000000000) // 1000) AS ts FROM v_changes), i AS ({ISLAND_SQL.replace('600 SECOND', '300 MILLISECOND').replace('v_changes', 'c')}) SELECT min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS changes, count(DISTINCT lower(path)) AS paths FROM i GROUP BY s")
def watch_debounce_300ms(spark, sf_dir):
    """The debounce of watch mode, over times a thousand times as dense."""
    dense = F.expr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(floor(pmod(unix_micros(cast(ts as timestamp)), 2592000000000) / 1000) as decimal(18, 6)) / 1000000)")
    return sessions(view(spark, sf_dir, "v_changes").select("path", dense.alias("ts")))


@query("SELECT lower(path) AS path, max(ts) AS ts, count(*) AS changes FROM v_changes GROUP BY lower(path)")
def watch_latest_per_path(spark, sf_dir):
    return latest_per_path(view(spark, sf_dir, "v_changes"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
