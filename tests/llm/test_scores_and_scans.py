"""Learned, searched and scanned results: held-out accuracy, recall, brute force, round trips."""

import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import decontaminate, language, mixing, nearest, quality, secrets, tokens
from keelson.llm import queries as Q

SF = "/root/testdata/sf0.01"
AWKWARD = [None, "", "   \n", "x", "123 456", "🎉", "a" * 5000, "é ü", "tiny\ttext"]


@pytest.fixture(scope="module")
def awkward(spark):
    rows = [(i if i else None, t, "en", "s", 0.5) for i, t in enumerate(AWKWARD)]
    return spark.createDataFrame([*rows, rows[3]], "doc_id long, text string, lang string, source string, score double")


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = Q.op8_language_id(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 100


def test_language_awkward(spark, awkward):
    got = language.identify(awkward).collect()
    assert len(got) == len(AWKWARD) + 1
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 4, 5)) and by[None].lang_pred == "und"
    assert by[3].lang_pred == "en" and language.identify(awkward.limit(0)).collect() == []


def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = Q.op6_quality_classifier(spark, SF).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows) > 30


def test_quality_gradient_and_awkward(spark, awkward):
    x, first = quality.encode(__import__("pyarrow").array(["one two three " * 50, "", None, "x"]))
    rng = np.random.default_rng(0)
    p = {"W": rng.normal(size=(quality.FEATURES, 3)), "b": rng.normal(size=3), "V": rng.normal(size=(3, 2)), "U": rng.normal(size=(3, 2)), "w": rng.normal(size=2), "c": rng.normal(size=3), "d": np.zeros(1)}
    model, y, weight = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), p), np.array([1.0, 0, 1, 0]), np.ones(4)

    def loss():
        s = model.score(x, first)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    g = model.gradient(x, first, y, weight)
    for name in p:
        at = (0,) * p[name].ndim
        was = p[name][at]
        p[name][at] = was + 1e-5
        up = loss()
        p[name][at] = was - 1e-5
        down = loss()
        p[name][at] = was
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-5
    labels = spark.createDataFrame([(3, 1, 0), (8, 0, 0), (7, 1, 1), (6, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(awkward, labels).collect()
    assert len(got) == len(AWKWARD) + 1 and all(0 <= r.score <= 1 for r in got)
    assert [r.score for r in quality.classify(awkward, labels.limit(0)).collect()] == [0.5] * (len(AWKWARD) + 1)


def test_tokens_against_the_library():
    public_tokenizers, sentencepiece = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    c, model = tokens.Counter(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\n\n", "▁", "a", "the", "é", "🎉", "\t", "\r", "<s>", "</s>", "<0x0A>", "ing", "\x00", "123", ".", "{", "ﬁ", "　", "Hello", "ß"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert c.count(text) == len(model.encode(text)), repr(text)
    assert c.cuts and len(c.whole) > 10_000


def test_tokens_awkward(spark, awkward):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    got = {r.doc_id: r for r in tokens.token_counts(awkward, public_tokenizers.path("piece_bpe_32k.model"), 100).collect()}
    assert got[None].n_tokens == got[1].n_tokens == 0 and got[6].over_limit and got[7].n_bytes == 5


def brute_matches(items, texts):
    cut = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    grams = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    from collections import Counter

    out = {}
    for d, t in texts:
        w = cut(t)
        for i, x in items:
            own = cut(x)
            want, best = Counter(grams(own)), 0
            for p in range(max(1, len(w) - len(own) + 1)) if own and w else ():
                have = Counter(grams(w[p : p + len(own)]))
                common = sum((have & want).values())
                best = max(best, common / (sum(have.values()) + sum(want.values()) - common))
            if best >= 0.75:
                out[d, i] = best
    return out


def test_decontamination_against_all_windows(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(500)]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k))
    items = [(i, text(rng.choice([8, 20, 30, 45]))) for i in range(12)] + [(50, "only four words here"), (51, None), (52, ""), (53, items_repeat := "la " * 20)]
    rows = [(i, text(60)) for i in range(10)]
    for i, (_, x) in enumerate(items[:12]):
        w = x.split()
        for k in range(i % 3):
            w[rng.randrange(len(w))] = "edited"
        rows.append((100 + i, text(30) + ". " + " ".join(w).upper() + "! " + text(10)))
    rows += [(200, "Only four, words here"), (201, None), (202, ""), (203, items[3][1]), (204, items_repeat), (203, items[3][1]), (205, "only four words here and more"), (206, "x y z only four words here a b c"), (207, text(20_000) + " only four words here"), (None, "so only four words here"), (208, "only four other words here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(0))
    items += [(54, "lonely"), (55, "two words")]
    rows += [(209, "a lonely word"), (210, "words two, two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit(0))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = decontaminate.contaminated(docs, bench).collect()
    want = brute_matches([(i, x) for i, x in items if x], rows)
    assert {(r.doc_id, r.item_id): r.similarity for r in got} == pytest.approx(want)
    assert len(got) == len(want) + sum(d == 203 for d, _ in want) and len(want) >= 8
    assert decontaminate.contaminated(docs, bench.limit(0)).collect() == []
    assert decontaminate.contaminated(docs.limit(0), bench).collect() == []


def test_decontamination_works_in_slices(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "ITEMS", 7)
    assert sorted(map(tuple, decontaminate.contaminated(docs, bench).collect())) == whole


def test_secrets_against_patterns(spark):
    rng = random.Random(9)
    hexes = "".join(rng.choices("0123456789abcdef", k=40))
    strong = "".join(rng.choices(string.ascii_letters + string.digits, k=128))
    access = "AKIA" + "".join(rng.choices(string.ascii_uppercase + string.digits, k=16))
    texts = [None, "", f'é token = "{hexes}" x', f"PassWord: abc {access}", f"key {strong} end", "getUserNameFromFileList22 dataKeyValueTest1", "secret=short1 secret=abc", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "api_key='x.y/z+q=' apikey:\tno"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert (got[2].n_assign, got[2].n_hex) == (1, 1) and got[2].spans == f"assign:2:{2 + 9 + 40},hex:{2 + 9}:{2 + 9 + 40}"
    assert got[3].n_access == 1 and got[3].n_assign == 0
    assert got[4].spans == "random:4:132" and got[5].spans == "" and got[7].n_hex == 1
    assert got[6].n_assign == 1 and got[8].n_assign == 1 and got[0].spans == got[1].spans == ""
    masked = {r.doc_id: r.t for r in docs.select("doc_id", secrets.redact(F.col("text")).alias("t")).collect()}
    assert masked[0] is None and masked[2] == 'é [secret]" x' and masked[5] == texts[5]


def test_nearest_recall_and_awkward(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 24))
    v = centres[rng.integers(6, size=3000)] + 0.4 * rng.normal(size=(3000, 24))
    v[:400] = v[0]
    rows = [(int(i), x.tolist(), 1) for i, x in enumerate(v)]
    bad = [(3100, None, 1), (3200, [0.0] * 24, 1), (3300, [float("nan")] * 24, 1), (3400, [1.0] * 5, 1), (3500, [None] + [1.0] * 23, 1), (None, [1.0] * 24, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, rank int").repartition(3)
    got = nearest.neighbours(df, F.col("vec_id") % 100 == 0).collect()
    hits = total = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        d[q] = np.inf
        want = np.lexsort((np.arange(3000), d))[:10].tolist()
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 11))
        assert [(r.score, r.vec_id) for r in mine] == sorted((r.score, r.vec_id) for r in mine)
        assert all(abs(r.score - d[r.vec_id]) < 1e-9 for r in mine)
        hits += len({r.vec_id for r in mine} & set(want))
        total += 10
    assert hits >= 0.9 * total and {r.query_id for r in got} == set(range(0, 3000, 100))
    assert nearest.neighbours(df.limit(0), F.lit(True)).collect() == []
    assert nearest.neighbours(df.where("vec_id = 7"), F.lit(True)).collect() == []


def test_mixing_budget_and_awkward(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), "big" if i % 3 else f"s{i % 5}") for i in range(900)] + [(None, "a b", None), (5, None, "s0"), (5, "x", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("weight", F.lit(1))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    total = sum(r.n_tokens for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        used, goal = sum(r.n_tokens * r.copies for r in rs), rs[0].weight * total
        assert goal - 45 - total * 1e-6 <= used <= goal + total * 1e-6
        assert max(r.copies for r in rs) - min(r.copies for r in rs) <= 1 and max(r.copies for r in rs) <= 5
    share = np.array([rs[0].weight for rs in by.values() if rs[0].weight])
    assert -(share * np.log(share)).sum() >= 0.97 * np.log(len(share)) - 1e-4 or max(r.copies for r in got) >= 3
    assert mixing.mix(docs.limit(0)).collect() == []
    assert {r.copies for r in mixing.mix(docs.withColumn("text", F.lit(" "))).collect()} <= {0, 1}
