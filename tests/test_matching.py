"""The one pass for keywords, pieces of texts, added lines: against plain walks."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keelson.catalogue import DETECTORS, Detector
from keelson.functions import keywords as K
from keelson.functions import patches as P
from keelson.operators import diff
from keelson.operators.match import alone, matches
from keelson.plans import catalog


def low(text):
    return bytes(K._LOWER[np.frombuffer(text.encode(), np.uint8)])


def test_all_occurrences_within_each_text(monkeypatch):
    rng = random.Random(1)
    words = ["AKIA", "pwd", "Pass", "x-", "a", "ssw", "Password=", "é="]
    texts = ["".join(rng.choice("akiAKIpPwWdDasSx-=ordé\n") for _ in range(rng.randint(0, 60))) for _ in range(800)] + [None, "", "Password=AKIA", "Password=AKIA"]
    for size in (1, 500, 4 << 20):
        monkeypatch.setattr(K, "PASS", size)
        matcher, got = K.Matcher(words), set()
        for h in matcher.hits(pa.array(texts)[2:]):
            got |= {(h.begin + int(t), int(p - h.cuts[t]), int(w)) for p, w, t in zip(h.place, h.word, h.text, strict=True)}
        assert got == {(i, m.start(), w) for i, t in enumerate(texts[2:]) for w, k in enumerate(words) for m in re.finditer(b"(?=%s)" % re.escape(K.folded(k)), low(t or ""))}
    with pytest.raises(ValueError):
        K.Matcher([""])


def test_present_keywords(spark):
    rows = [("AKIA and pwd",), ("nothing",), (None,), ("",), ("PWDakia",)]
    got = [r.k for r in spark.createDataFrame(rows, "t string").select(K.present(F.col("t"), ["pwd", "AKIA"]).alias("k")).collect()]
    assert got == [["AKIA", "pwd"], [], None, [], ["AKIA", "pwd"]]


def test_pieces_lose_no_match(spark):
    """The same detectors over whole texts, and over lines that hold a keyword."""
    rng = random.Random(4)
    bits = ["AKIA" + "Q" * 16, "xAKIA" + "Q" * 16, "AKIA" + "R" * 16 + "é", "ghp_" + "a1" * 18, "xoxb-" + "1" * 10 + "-", "glpat-" + "z" * 20, 'Password = "really-mine";', "é", "\n", "\r\n", " ", "plain", "😀", "Password=abcd;"]
    texts = [("a.cs" if i % 2 else "b.json", "".join(rng.choices(bits, k=rng.randint(0, 30)))) for i in range(300)]
    df = spark.createDataFrame(texts, "path string, content string").repartition(2)
    one = tuple(d for d in DETECTORS if d.one_line)
    assert len(one) == 10
    whole = tuple(Detector(**{**d.__dict__, "one_line": False}) for d in one)
    show = lambda ds: sorted((r.file, r.detector_id, r.line, r.column, r.offset, r.hash16) for r in matches(df, ds).collect())
    assert show(one) == show(whole) and len(show(one)) > 300


def test_expressions_that_look_around_see_the_whole_text():
    assert alone('(?i)("k"\\s*:\\s*")([^"$]{3,})"') and alone(r"(a\.)(b)")
    assert not any(alone(x) for x in ("^a", "a$", r"a\b", "(?<=x)a", "(?!x)a", "(?<!x)(a)", r"\Aa", r"a\z", r"\Qa\E"))


def random_patch(rng):
    out = rng.choice([[], ["diff --git a b", "--- a", "+++ b"]])
    at = 1
    for _ in range(rng.randint(0, 4)):
        at += rng.randint(0, 9)
        out.append(f"@@ -1,2 +{at}{rng.choice(['', ',3'])} @@{rng.choice(['', ' +x'])}")
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(["+", "+a", " k", "-g", "\\ no", "", "+++x", "++y", "@", "é"])
            out.append(line)
            at += not line.startswith(("-", "\\", "+++"))
    return rng.choice(["\n", "\r\n", "\r"]).join(out) + rng.choice(["", "\n", "\n\n"])


def test_ranges_are_the_added_lines(spark):
    rng = random.Random(9)
    patches = [None, "", "\n", "@@", "+a", "@@ x\n+a", "@@ -1 +99999999999 @@\n+a", *(random_patch(rng) for _ in range(400))]
    want = [sorted({n for n, _ in diff.enumerate_added(p)}) for p in patches]
    got = P.ranges(pa.array(patches))
    assert [[n for a, b in zip(*r, strict=True) for n in range(a, b + 1)] for r in got] == want
    rows = [(i, a, b) for i, (a, b) in enumerate(got)]
    df = spark.createDataFrame(rows, "i int, starts array<int>, stops array<int>")
    held = df.select("i", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("n")).join(df, "i").where(P.holds(F.col("starts"), F.col("stops"), F.col("n")))
    found = {(r.i, r.n) for r in held.select("i", "n").collect()}
    assert found == {(i, n) for i, w in enumerate(want) for n in w if n <= 60}
    native = {}
    for r in diff.added_lines(spark.createDataFrame([(str(i), "p", p) for i, p in enumerate(patches)], "sha string, path string, patch string")).collect():
        native.setdefault(int(r.sha), set()).add(r.line)
    assert [sorted(native.get(i, ())) for i in range(len(patches))] == want


def test_a_large_patch_is_linear(spark):
    """100,000 added lines, 10,000 matches, every other line added."""
    n = 100_000
    body = [f'k{i} = "AKIA{i:016d}"' if i % 10 == 0 else f"line {i}" for i in range(n)]
    patch = "@@ -1 +1 @@\n" + "\n".join(("+" if i % 20 < 10 else " ") + x for i, x in enumerate(body))
    df = spark.createDataFrame([("s", "a.env", "\n".join(body), patch)], "sha string, path string, content string, patch string")
    key = tuple(d for d in DETECTORS if d.id == "aws.access_key_id")
    whole = (Detector(**{**key[0].__dict__, "one_line": False}),)
    lines = [[r.line for r in matches(df, ds, keep=("sha",), patch="patch").collect()] for ds in (key, whole)]
    assert sorted(lines[0]) == sorted(lines[1]) == [i + 1 for i in range(0, n, 20)]


def test_single_matches_are_placed_as_several_are(spark):
    """A match whose text stands earlier too, where the expression does not hold; wide characters; groups; lines that count."""
    aws = tuple(Detector(**{**d.__dict__, "one_line": False}) for d in DETECTORS if d.id == "aws.access_key_id")
    other = (Detector("o", "O", "low", "(?<=é)((k)=)([a-z]+)", 2, 3, keywords=("k=",)), Detector("p", "P", "low", "((k)=)([0-9]+)", 2, 3, keywords=("k=",)))
    key = "AKIA" + "Q" * 16
    rows = [("a", f"😀x{key}\né {key}"), ("b", "k=ab\n😀ék=ab k=77"), ("c", f"\n\n😀 {key}"), ("d", f"{key}\n{key} {key}"), ("e", ""), ("f", None)]
    df = spark.createDataFrame([(p, c, "@@ -1 +00000000000002 @@\n+x") for p, c in rows], "path string, content string, patch string")
    show = lambda **more: sorted((r.file, r.secret_type, r.line, r.column, r.offset, r.hint) for r in matches(df, (*aws, *other), **more).collect())
    hint = "AwsAccessKey=***"
    want = [("a", "AwsAccessKey", 2, 3, 25, hint), ("b", "O", 2, 5, 9, "k=***"), ("b", "P", 2, 10, 14, "k=***"), ("c", "AwsAccessKey", 3, 3, 4, hint), ("d", "AwsAccessKey", 1, 1, 0, hint), ("d", "AwsAccessKey", 2, 1, 21, hint), ("d", "AwsAccessKey", 2, 22, 42, hint)]
    assert show() == want
    assert show(patch="patch") == [w for w in want if w[2] == 2]


def test_views_of_secrets_exchange_secrets_only(spark):
    """Neither the order of matches nor what is shown of them is worked out where it is not asked for."""
    for name in ("still_present", "still_present_only", "removed_only"):
        plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "sha2" in plan
        assert not [x for x in ("min(struct", "author_when", "=***") if x in plan], name
