"""The command, its configuration, checks of requests, limits, charsets."""

import json
import os
import re
import subprocess
import time

import pytest

from keelson import cli, requests
from keelson.catalogue import DETECTORS
from keelson.engine import Engine
from keelson.operators import diff, findings, graph
from keelson.sources import config, git
from keelson.sources.tree import ScanOptions, decode, read_tree
from keelson.streaming.watch import watch

AKIA = "AKIA" + "IOSFODNN7EXAMPLE"


@pytest.fixture()
def run(spark, capsys):
    def go(*arguments):
        out = []
        code = cli.main(list(map(str, arguments)), spark, out.append)
        return code, "\n".join(out), capsys.readouterr().err

    return go


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.cs").write_text(f'var k = "{AKIA}";\n')
    (tmp_path / "src/b.json").write_text('{"Password": "r3al-secret-here"}\n')
    return tmp_path


@pytest.fixture()
def repository(tmp_path):
    def call(*args, at=0):
        env = {**os.environ, "GIT_AUTHOR_DATE": f"2024-03-15T10:0{at}:00Z", "GIT_COMMITTER_DATE": f"2024-03-15T10:0{at}:00Z"}
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=T", "-c", "user.email=t@t", *args], check=True, capture_output=True, env=env)

    call("init", "-q", "-b", "main")
    texts = [("a.env", f"key={AKIA}\n"), ("b.env", "Password=real-one-here\n"), ("a.env", "nothing\n")]
    for i, (name, text) in enumerate(texts):
        (tmp_path / name).write_text(text)
        call("add", "-A")
        call("commit", "-qm", f"commit {i}", at=i)
    return tmp_path


def test_exit_codes_and_formats(run, tree):
    code, out, _ = run("-p", tree)
    assert code == 1 and "AwsAccessKey" in out and "2 findings" in out
    code, out, _ = run("-p", tree, "-f", "json", "-s", "CRITICAL")
    assert code == 1 and [f["secretType"] for f in json.loads(out)["findings"]] == ["AwsAccessKey"]
    code, out, _ = run("-p", tree, "--exclude", "**/*.cs", "**/*.json")
    assert (code, out) == (0, "No findings.")
    code, out, _ = run("-p", tree, "-f", "sarif", "-o", tree / "out.sarif")
    assert code == 1 and out == "" and json.loads((tree / "out.sarif").read_text())["version"] == "2.1.0"
    assert "\x1b[1;31mcritical" in run("-p", tree, "--color", "always")[1]
    for wrong in (["--nonsense"], ["-s", "3"], ["-f", "xml"], ["-p", tree / "missing"], ["--max-file-size", "x"], ["history", "--since", "soon"], ["history", "-p", tree]):
        code, out, err = run(*wrong)
        assert code == 2 and out == "" and err.startswith("error: "), wrong


def test_baseline_round_trip(run, tree):
    known = tree / "deep/known.json"
    assert run("-p", tree, "--write-baseline", known)[0] == 1
    body = json.loads(known.read_text())
    assert body["schemaVersion"] == "1" and len(body["entries"]) == 2 and set(body["entries"][0]) == {"file", "line", "secretType", "hint"}
    assert run("-p", tree / "src", "--baseline", known)[0] == 1
    assert run("-p", tree, "--baseline", known, "--exclude", "deep/**")[0] == 0
    assert run("-p", tree, "--baseline", tree / "none.json")[0] == 1


def test_configuration_takes_effect(run, tree, monkeypatch):
    (tree / config.NAME).write_text('{"Exclude": ["**/*.cs"], "MaxFileSizeBytes": 100000, "IncludePii": true}')
    out = json.loads(run("-p", tree, "-f", "json")[1])
    assert [f["file"] for f in out["findings"]] == ["src/b.json"]
    # A flag wins over the file
    assert len(json.loads(run("-p", tree, "-f", "json", "--exclude", "**/*.md")[1])["findings"]) == 2
    monkeypatch.setenv("KEELSON_EXCLUDE", "**/*.json|**/.keelson.json")
    assert [f["file"] for f in json.loads(run("-p", tree, "-f", "json")[1])["findings"]] == ["src/a.cs"]
    o = config.scan_options(config.load(str(tree), str(tree)), severity="high", follow_symlinks=True)
    assert (o.severity, o.include_pii, o.follow_symlinks, o.max_file_size, o.include_generated) == ("high", True, True, 100000, False)


def test_history_cap_and_views(run, repository):
    code, out, err = run("history", "-p", repository, "--max-commits", 2)
    assert code == 2 and out == "" and "3 commits" in err
    kinds = lambda *a: (lambda r: (r[0], sorted(f["secretType"] for f in json.loads(r[1])["findings"])))(run("history", "-p", repository, "-f", "json", *a))
    assert kinds("--all-history", "--max-commits", 1) == (1, ["AwsAccessKey", "ConnectionString"])
    assert kinds("--still-present-only") == (1, ["ConnectionString"])
    assert kinds("--removed-only") == (1, ["AwsAccessKey"])
    assert kinds("--since", "2030-01-01") == (0, [])
    assert run("history", "-p", repository, "--still-present-only", "--removed-only")[0] == 2
    assert "2 findings" in run("history", "-p", repository)[1]


def test_changes_with_renames_and_odd_names(spark, repository):
    call = lambda *args: subprocess.run(["git", "-C", str(repository), "-c", "user.name=T", "-c", "user.email=t@t", *args], check=True, capture_output=True)
    body = "".join(f"line {i}\n" for i in range(40))
    (repository / 'od"d é\t.txt').write_text(body)
    (repository / "bin.dat").write_bytes(b"\0\1\2")
    call("add", "-A")
    call("commit", "-qm", "odd")
    call("mv", 'od"d é\t.txt', "plain.txt")
    (repository / "plain.txt").write_text(body + "diff --git no\nadded\n")
    (repository / "b.env").unlink()
    call("add", "-A")
    call("commit", "-qm", "moved")
    log = git.commits(spark, str(repository))
    rows = {(r.path, r.status): r for r in git.file_diffs(str(repository), log).collect()}
    assert rows['od"d é\t.txt', "added"].content == body and rows["bin.dat", "added"].content == ""
    moved = rows["plain.txt", "renamed"]
    assert diff.enumerate_added(moved.patch) == [(41, "diff --git no"), (42, "added")]
    assert rows["b.env", "deleted"].patch == "" and ("a.env", "modified") in rows and ("a.env", "added") in rows


def test_places_of_many_matches(spark):
    texts = ["\n".join(f"x{'é' * (i % 7)} AKIA{i:016d};" + ("AKIA" + "Z" * 16 if i % 3 else "") for i in range(n)) for n in (1, 63, 64, 65, 300)]
    texts += [" ".join(f"AKIA{i:016d}" for i in range(200))]
    df = spark.createDataFrame([(f"{i}.env", t) for i, t in enumerate(texts)], "path string, content string")
    aws = tuple(d for d in DETECTORS if d.id == "aws.access_key_id")
    got = sorted((r.file, r.line, r.column) for r in findings.working_tree(df, aws).collect())
    want = [(f"{i}.env", t.count("\n", 0, m.start()) + 1, m.start() - (t.rfind("\n", 0, m.start()) + 1) + 1) for i, t in enumerate(texts) for m in re.finditer("AKIA[0-9A-Z]{16}", t)]
    assert got == sorted(want)


def test_a_long_chain_of_commits(spark):
    edge = spark.createDataFrame([(str(i), str(i - 1)) for i in range(1, 1500)], "sha string, parent string")
    assert graph.closure(spark.createDataFrame([("1499",)], "sha string"), edge).count() == 1500


def test_requests():
    ok = requests.boundary("/work/space/src", "/work/space", home="/home/x")
    assert ok.allowed and ok.path == "/work/space/src"
    assert requests.boundary("/Work/Space/src/../a", "/work/space", home="/home/x").allowed
    for path, reason in (("", "no path"), (None, "no path"), ("a\0b", "character"), ("/etc/passwd", "system"), ("/", "system"), ("/work/spaces", "not in the workspace"), ("/work/space/../other", "not in the workspace")):
        d = requests.boundary(path, "/work/space", home="/home/x")
        assert not d.allowed and reason in d.reason, path
    assert requests.boundary("/other", "/work/space", True, "/home/x").allowed and not requests.boundary("/usr/lib", "/work/space", True, "/home/x").allowed
    assert requests.boundary("/var/home/me/src", "/var/home/me", home="/var/home/me").allowed
    assert requests.severity("High") == "high" and requests.instant(" ") is None and requests.instant("2024-01-02T03:04:05+00:00")
    for wrong in (lambda: requests.severity("3"), lambda: requests.severity(None), lambda: requests.instant("soon"), lambda: requests.commits(0)):
        with pytest.raises(ValueError):
            wrong()


def test_limits(spark, tree):
    late = read_tree(spark, str(tree), deadline=time.time() - 1).collect()
    assert len(late) == 2 and {r.size for r in late} == {-1}
    result = Engine(spark).scan(str(tree), seconds=0)
    assert result.truncated and result.files_skipped == 0 and result.exit_code() == 0
    result = Engine(spark).scan(str(tree), seconds=600)
    assert not result.truncated and result.findings.count() == 2
    result = Engine(spark, options=ScanOptions(max_files=1)).scan(str(tree))
    assert result.truncated and [r.file for r in result.findings.collect()] == ["src/a.cs"]
    table = spark.createDataFrame([("x.cs", f'"{AKIA}"'), ("y.bin", None)], "path string, content string")
    result = Engine(spark).scan(table)
    assert result.findings.count() == 1 and result.files_skipped == 1


def test_charsets():
    for text, name in (("これは日本語の設定ファイルです。パスワード", "shift_jis"), ("これは日本語の設定ファイルです。", "euc_jp"), ("这是一个配置文件，里面有密码", "gb18030"), ("這是一個設定檔案，裡面有密碼與說明", "big5"), ("이것은 설정 파일입니다", "euc_kr"), ("Größe für Straße, déjà vu", "cp1252")):
        assert decode(f"# {text}\nkey={AKIA}\n".encode(name)) == f"# {text}\nkey={AKIA}\n", name


def test_watch_goes_by_the_options(spark, tmp_path):
    (tmp_path / "w").mkdir()
    for name in ("a.cs", "b.md", "c.g.cs"):
        (tmp_path / "w" / name).write_text(f'"{AKIA}"')
    seen = []
    o = ScanOptions(exclude=("**/*.md",), include_generated=True)
    q = watch(spark, str(tmp_path / "w"), DETECTORS, lambda df: seen.extend(r.file for r in df.collect()), str(tmp_path / "ck"), since_ns=0, once=True, options=o)
    q.awaitTermination(60)
    assert sorted(seen) == ["a.cs", "c.g.cs"]
