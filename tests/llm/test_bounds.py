"""Limits that drop nothing: recall near thresholds, exact search, remembered parts, families of runs."""

import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keelson.llm import decontaminate, nearest, quality, secrets, tokens

SF = "/root/testdata/sf0.01"


def test_windows_just_above_the_threshold_are_found():
    """Items with words changed until their similarity lies between 0.75 and 0.8."""
    rng = random.Random(12)
    items, texts, want = [], [], []
    while len(want) < 400:
        n = rng.randint(30, 200)
        w = [f"v{rng.randrange(5000)}" for _ in range(n)]
        changed = list(w)
        for p in rng.sample(range(n), max(1, n // rng.randint(30, 60))):
            changed[p] = "other"
        grams = lambda x: [tuple(x[i : i + 5]) for i in range(len(x) - 4)]
        a, b = set(grams(w)), set(grams(changed))
        if 0.75 <= len(a & b) / len(a | b) <= 0.8:
            want.append(len(items))
            items.append(" ".join(w))
            texts.append("some words before " + " ".join(changed) + " and some after")
    index = decontaminate.Items(list(range(len(items))), items)
    found = decontaminate.matches(index, pa.array(texts))
    hits = sum(any(i == m[0] for m in own) for i, own in zip(want, found, strict=True))
    assert hits >= 0.97 * len(want), hits


def test_exact_search_is_exact_with_repeated_ids(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(900, 16))
    ids = [*range(890), *range(10)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in zip(ids, v, strict=True)], "vec_id long, embedding array<double>").repartition(3)
    got = nearest.neighbours(df, F.col("vec_id").isin(100, 200, 300), patience=None).collect()
    for q in (100, 200, 300):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        want = sorted((d[i], ids[i]) for i in range(900) if ids[i] != q)[:10]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.vec_id for r in mine] == [i for _, i in want] and [r.score for r in mine] == pytest.approx([x for x, _ in want])


def test_queries_in_slices(spark, monkeypatch):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = F.col("vec_id") % 100 == 0
    whole = sorted(map(tuple, nearest.neighbours(rows, asked, patience=None).collect()))
    monkeypatch.setattr(nearest, "QUERIES", 3)
    assert sorted(map(tuple, nearest.neighbours(rows, asked, patience=None).collect())) == whole


def test_remembered_parts_are_bounded_in_bytes(monkeypatch):
    public_tokenizers, sentencepiece = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(tokens, "REMEMBERED", 20_000)
    c, rng = tokens.Counter(path), random.Random(3)
    for _ in range(60):
        text = " ".join("".join(rng.choices("abcdefgh\n", k=rng.choice([3, 9, 2000]))) for _ in range(rng.randint(1, 30)))
        assert c.count(text) == len(model.encode(text))
        assert sum(len(w) for w in c.words if w not in c.whole) + sum(map(len, c.tails)) <= max(20_000, 3 * len(text))


def test_tokens_of_an_empty_table_and_clashing_columns(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "a b", 7), (1, "a b", 8), (None, "c", 9)], "doc_id long, text string, n_tokens long")
    got = tokens.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model"))
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == 3
    assert tokens.token_counts(docs.limit(0), public_tokenizers.path("piece_bpe_32k.model")).collect() == []


def key(rng, n):
    return "".join(rng.choices(string.ascii_letters + string.digits, k=n))


def test_a_long_document_does_not_starve_a_key():
    """Keys of 64 characters among 100 and 300 identifiers, against how often they are found alone."""
    parts = "user order cache table index count value report client server".split()
    alone, among, wrong = 0, 0, 0
    for seed in range(60):
        rng = random.Random(seed)
        names = ["".join(w.capitalize() for w in rng.choices(parts, k=4)) + str(rng.randrange(100)) for _ in range(100 + 200 * (seed % 2))]
        secret = key(rng, 64)
        own, found = secrets.spans(pa.array([secret, " ".join([*names[:50], secret, *names[50:]])]))
        alone += len(own)
        among += any(e - s == 64 for s, _, e in found)
        wrong += sum(e - s != 64 for s, _, e in found)
    assert alone >= 45 and among >= 0.85 * alone and wrong <= 2


def test_short_keys_beside_a_very_long_run():
    rng = random.Random(2)
    found = 0
    for _ in range(20):
        secret = key(rng, 96)
        (spans,) = secrets.spans(pa.array([f"{key(rng, 50_000)} and {secret} end"]))
        found += any(s == 50_005 for s, _, _ in spans)
        assert spans[0][:2] == (0, 3)
    assert found >= 18


def test_base_spans_against_plain_patterns(spark):
    assign = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)

    def plain(text):
        text = text or ""
        own = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6 and m[0].isascii()]
        own += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        return sorted(own + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])

    rng = random.Random(5)
    pieces = ["password", "Token", "API_KEY", "apikey", "secret", " ", "=", ":", '"', "'", "abc123", "x.y/z", "é", "🎉", "AKIA", "ABCDEFGH12", "0123456789abcdef", "\n", "passwd = ", "deadbeef"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(3000)] + [None, "", "x" * 300_000 + " token=abcdefgh"]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    docs = spark.createDataFrame([*enumerate(texts), (None, "secret=abcdef"), (0, "again")], "doc_id long, text string")
    got = sorted((str(r[0]), *r[1:5]) for r in secrets.scan(docs).collect())
    want = []
    for i, t in [*enumerate(texts), (None, "secret=abcdef"), (0, "again")]:
        own = plain(t)
        n = [sum(k == kind for _, k, _ in own) for kind in range(3)]
        want.append((str(i), *n, hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in own).encode()).hexdigest()))
    assert got == sorted(want) and secrets.scan(docs.limit(0)).collect() == []


def test_quality_of_contradicting_labels_and_empty_documents(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (1 + i % 40)) for i in range(60)] + [(1000, "word " * 60_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(4, 1), (1000, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 61 and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(docs.limit(0), labels).collect() == []
