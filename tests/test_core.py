"""Detectors, expressions, sources, reports and watching."""

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from keelson import report
from keelson.catalogue import DETECTORS, HIGH_ENTROPY, Detector, library
from keelson.engine import Engine, OverCap
from keelson.functions import exprs as X
from keelson.operators import baseline, diff, findings
from keelson.schemas import FORBIDDEN
from keelson.sources import config
from keelson.sources.tree import ScanOptions, decode, read_tree, walk
from keelson.streaming.watch import watch

AKIA = "AKIA" + "IOSFODNN7EXAMPLE"
CASES = [
    ("config.cs", f'var key = "{AKIA}";', "AwsAccessKey"),
    ("config.cs", '"ASIA' + 'TESTKEYID0000000"', "AwsAccessKey"),
    ("deploy.sh", "GITHUB_TOKEN=ghp_" + "a1B2" * 9, "GitHubToken"),
    ("deploy.sh", "github_pat_" + "A" * 82, "GitHubToken"),
    ("Payments.cs", "sk_live_" + "abcdefghijklmnopqrstuvwx", "StripeKey"),
    ("deploy.sh", "glpat-" + "a1b2c3d4e5f6g7h8i9j0", "GitLabToken"),
    ("config.cs", "xoxb-" + "1111111111-2222222222-aaaaaaaaaaaa", "SlackToken"),
    ("key.txt", "-----BEGIN RSA " + "PRIVATE KEY-----\nx", "PrivateKey"),
    ("appsettings.json", "x;AccountKey=" + "A" * 86 + "==;", "AzureStorageKey"),
    ("appsettings.json", '"JwtSigningKey": "a-very-long-real-signing-secret-12345"', "JwtSecret"),
    ("appsettings.json", '"Password": "r3al-secret-here"', "Password"),
    ("appsettings.json", '"Default": "Server=db;Password=Pa$$w0rd!"', "ConnectionString"),
    ("Service.cs", "Password\n   =hunter2-real;", "ConnectionString"),
    ("appsettings.json", '"Password": "changeme"', None),
    ("Readme.txt", "plain prose", None),
    ("x.txt", f"é{AKIA}", None),
]


def test_detectors(spark):
    df = spark.createDataFrame([(f"{i}/{p}", c) for i, (p, c, _) in enumerate(CASES)], "path string, content string")
    got = {}
    for r in findings.working_tree(df, DETECTORS).collect():
        got.setdefault(int(r.file.split("/")[0]), set()).add(r.secret_type)
    for i, (_, _, want) in enumerate(CASES):
        assert (want in got.get(i, set())) if want else i not in got, CASES[i]


def test_value_that_repeats_its_key_has_the_right_place_and_no_leak(spark):
    df = spark.createDataFrame([("a.env", "first\nPassword=Password1;")], "path string, content string")
    found = findings.working_tree(df, DETECTORS)
    r = found.first()
    assert (r.line, r.column, r.hint) == (2, 10, "ConnectionString=***")
    assert not FORBIDDEN & {c.lower() for c in found.columns}
    plan = found.groupBy("file").count()._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan[: plan.find("Exchange")]


def test_severity_and_opt_in(spark):
    assert HIGH_ENTROPY not in library() and HIGH_ENTROPY in library(True) and HIGH_ENTROPY not in library(True, "medium")
    assert {d.severity for d in library(least="critical")} == {"critical"}
    with pytest.raises(ValueError):
        library(least="3")


def test_scalars(spark):
    def one(c):
        return spark.range(1).select(c.alias("x")).first().x

    for v in ("changeme", "ChangeMe", "your-secret-here", "***", "xxxx", "", "   ", "<secret>", "dummy", '"placeholder"'):
        assert one(X.is_placeholder(F.lit(v))), v
    for v in ("p@ssw0rd!real", "real-looking-key-123", "AKIA" + "EXAMPLE1234567"):
        assert not one(X.is_placeholder(F.lit(v))), v
    assert one(X.round_entropy(X.entropy(F.lit("aB3$kP9!xQ2#")))) == 3.6 and one(X.entropy(F.lit("aaaaaaaa"))) == 0
    for key, want in (("Password", "Password=***"), (None, "T=***"), ("weird key $$$", "T=***"), ("p@ssKEY", "T=***")):
        assert one(X.hint(F.lit("T"), F.lit(key).cast("string"), F.lit("p@ssw0rd-very-secret"))) == want
    for p, want in (("/Users/jane/code/file.cs", "~/code/file.cs"), ("/home/jane", "~"), (r"D:\Users\jane\code\x.cs", "~/code/x.cs"), ("src/a.json", "src/a.json")):
        assert one(X.redact_home(F.lit(p))) == want
    assert [one(X.sarif_level(F.lit(s))) for s in ("critical", "high", "medium", "low")] == ["error", "error", "warning", "note"]
    assert one(X.extension(F.lit("a/.env"))) == ".env"


def test_diffs(spark):
    cases = [
        (None, []),
        ("@@ -0,0 +1,3 @@\n+first\n+second\n+third", [(1, "first"), (2, "second"), (3, "third")]),
        ("@@ -10,3 +10,4 @@\n a\n b\n+inserted\n c", [(12, "inserted")]),
        ("@@ -1,3 +1,2 @@\n keep\n-removed\n+added", [(2, "added")]),
        ("@@ -1 +1,1 @@\n+a\n@@ -50 +60,1 @@\n+b", [(1, "a"), (60, "b")]),
        ("diff x\n--- a\n+++ b\n@@ -1 +1 @@\n+x\n\\ No newline at end of file", [(1, "x")]),
        ("@@ -1 +5 @@\r\n+++x\r\n+y\r\n", [(5, "y")]),
    ]
    df = spark.createDataFrame([(str(i), "p", c[0]) for i, c in enumerate(cases)], "sha string, path string, patch string")
    got = {}
    for r in diff.added_lines(df).collect():
        got.setdefault(int(r.sha), []).append((r.line, r.text))
    for i, (patch, want) in enumerate(cases):
        assert sorted(got.get(i, [])) == want == diff.enumerate_added(patch), patch
    diff.register_sql(spark)
    assert spark.sql("SELECT * FROM added_lines('@@ -1 +3 @@\n+q')").collect()[0].line == 3


@pytest.fixture()
def folder(tmp_path):
    for path, text in {"src/app.json": f'{{"ApiKey": "really-long-real-looking-key-12345", "k": "{AKIA}"}}', "src/.env": "Password=real-one-here", "bin/x.json": AKIA, "src/a.g.cs": AKIA, "image.png": AKIA, "big.txt": "x" * 2000 + " " + AKIA}.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(text)
    (tmp_path / "nul.txt").write_bytes(b"a\0b " + AKIA.encode())
    (tmp_path / "wide.txt").write_bytes(b"\xff\xfe" + AKIA.encode("utf-16-le"))
    (tmp_path / "link.txt").symlink_to(tmp_path / "src/.env")
    return tmp_path


def test_tree_scan(spark, folder):
    files = read_tree(spark, str(folder), ScanOptions(max_file_size=1500))
    assert {r.path for r in files.collect()} == {"src/app.json", "src/.env", "nul.txt", "wide.txt"}
    result = Engine(spark).scan(str(folder))
    assert {(r.file, r.secret_type) for r in result.findings.collect()} == {("src/app.json", "ApiKey"), ("src/app.json", "AwsAccessKey"), ("src/.env", "ConnectionString"), ("wide.txt", "AwsAccessKey"), ("big.txt", "AwsAccessKey")}
    assert result.files_skipped == 1 and result.exit_code() == 1
    critical = Engine(spark, options=ScanOptions(severity="critical")).scan(str(folder)).findings
    assert "ApiKey" not in {r.secret_type for r in critical.collect()}
    own = Engine(spark, (Detector("own", "Own", "high", "real-one-here"),)).scan(str(folder)).findings
    assert [r.file for r in own.collect()] == ["src/.env"]
    assert list(walk(str(folder / "none"), ScanOptions())) == [] and [p for _, p, _ in walk(str(folder / "bin/x.json"), ScanOptions())] == ["x.json"]
    assert decode(b"") == "" and decode(b"\xef\xbb\xbfx") == "x"


def test_baseline_and_reports(spark, folder):
    found = Engine(spark).scan(str(folder)).findings
    baseline.save(found, str(folder / "known"))
    known = baseline.load(spark, str(folder / "known"))
    assert baseline.suppress(found, known).isEmpty() and baseline.load(spark, str(folder / "missing.json")).isEmpty()
    assert not baseline.suppress(found, known.withColumn("line", F.col("line") + 1)).isEmpty()
    body = json.loads(report.to_json(found))
    assert body["schemaVersion"] == "1" and len(body["findings"]) == 5 and "secretType" in body["findings"][0]
    sarif = json.loads(report.to_sarif(found))
    assert sarif["version"] == "2.1.0" and len(sarif["runs"][0]["tool"]["driver"]["rules"]) == 3
    assert "entropy" not in report.to_wire(found)
    assert list(report.console(found))[-1] == "5 findings: 4 critical, 0 high, 1 medium, 0 low"
    assert list(report.console(found.limit(0))) == ["No findings."]
    assert report.use_colour("auto", environment={"FORCE_COLOR": "1"}) and not report.use_colour("auto", environment={"NO_COLOR": "1"})


def test_config(tmp_path):
    (tmp_path / "repo/sub").mkdir(parents=True)
    (tmp_path / "repo" / config.NAME).write_text('{"severity": "high", "includePii": true}')
    (tmp_path / config.NAME).write_text('{"severity": "low", "baseline": "b"}')
    c = config.load(str(tmp_path / "repo/sub"), str(tmp_path), {"KEELSON_SEVERITY": "critical"})
    assert (c["severity"], c["includepii"], c["baseline"]) == ("critical", True, "b")


def test_history_of_a_repository(spark, tmp_path):
    def git(*args, when=None):
        env = {"GIT_AUTHOR_DATE": when, "GIT_COMMITTER_DATE": when} if when else {}
        return subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=T", "-c", "user.email=t@t", *args], check=True, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin:/usr/local/bin", "HOME": str(tmp_path), **env}).stdout.strip()

    def commit(n, message, **files):
        for name, text in files.items():
            (tmp_path / f"{name}.env").write_text(text)
        git("add", "-A")
        git("commit", "-qm", message, when=f"2024-03-15T10:0{n}:00Z")
        return git("rev-parse", "HEAD")

    git("init", "-q", "-b", "main")
    first = commit(0, "start", a=f"x\nkey={AKIA}\n", b="Password=real-one-here\n")
    git("branch", "other")
    commit(1, "clean", a="x\n")
    commit(2, "again " + "AKIA" + "Z" * 16, c=f"key={AKIA}\n")
    commit(3, "drop", c="nothing\n")
    result = Engine(spark).scan_history(str(tmp_path))
    rows = {(r.source, r.secret_type): r for r in result.findings.collect()}
    assert result.commits_walked == 4 and len(rows) == 3
    key = rows["history", "AwsAccessKey"]
    assert (key.commit_sha, key.line, key.still_present, key.branches, key.author_name) == (first, 2, False, ["main", "other"], "[redacted]")
    assert rows["history", "ConnectionString"].still_present and rows["commitMessage", "AwsAccessKey"].file == "<commit-message>"
    with pytest.raises(OverCap, match="4 commits"):
        Engine(spark).scan_history(str(tmp_path), max_commits=3, refuse_over_cap=True)
    capped = Engine(spark).scan_history(str(tmp_path), max_commits=3)
    assert capped.truncated and capped.commits_walked == 3


def test_watch_reports_changes(spark, tmp_path):
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.cs").write_text(f'"{AKIA}"')
    seen = []
    q = watch(spark, str(tmp_path / "w"), DETECTORS, lambda df: seen.extend(r.file for r in df.collect()), str(tmp_path / "ck"), since_ns=0, once=True)
    q.awaitTermination(60)
    assert seen == ["a.cs"]
