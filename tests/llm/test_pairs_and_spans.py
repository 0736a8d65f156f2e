"""Operators with exact contracts against brute force, on awkward rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from keelson.llm import jaccard, substring_bytes, substring_words
from keelson.llm.components import connected

SCHEMA = "doc_id long, text string, lang string, source string, component_id string, marks string"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


def corpus(seed=3, n=60):
    """Copies, near copies, a common passage, a long text, repeats, blanks, nulls."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
    text = lambda k: " ".join(rng.choices(vocabulary, k=k))
    common, bases = text(60), [text(120) for _ in range(4)]
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = text(rng.randint(1, 90))
        elif kind == 1:
            t = text(20) + "\n" + common + "  " + text(20)
        elif kind in (2, 3):
            w = bases[i % 4].split()
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            t = " ".join(w)
        elif kind == 4:
            t = bases[0].upper()
        else:
            t = "tiny text" if i % 4 else (text(12) + "\t") * 3
        rows.append((i * 7 - 50, t))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, text(4000) + common), (1004, "x"), (1005, "a" * 300), (1006, "a" * 120), (None, common), (1007, bases[1]), (1007, bases[1])]
    return [(i, t, None, None, "c", "m") for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5)


def test_jaccard_against_all_pairs(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets = {}
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault(i, set()).update({tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set())
    least = {i: i for i in sets}

    def root(x):
        while least[x] != x:
            x = least[x]
        return x

    ids = sorted(i for i in sets if i is not None)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                least[max(x, y)] = min(x, y)
    got = jaccard.join(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert r.component_id == (None if r.doc_id is None else root(r.doc_id))
    assert len({r.component_id for r in got}) < len(ids)


def test_jaccard_index_loses_no_pair():
    """Keys alone, with many frequent shingles: similar sets meet in a key of a core, whatever their sizes."""
    import numpy as np

    rng = np.random.default_rng(5)
    t = jaccard.Thresholds()
    for size in (1, 2, 3, 5, 8, 13, 30, 64, 120, 300):
        for heavy_share in (0.0, 0.7, 1.0):
            for _ in range(12):
                a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.int64).astype(np.uint64) * np.uint64(2))
                drop, add = rng.integers(0, len(a) // 4 + 1), rng.integers(0, len(a) // 4 + 1)
                b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, add, dtype=np.int64).astype(np.uint64)]))
                if not len(b) or 4 * len(np.intersect1d(a, b)) < 3 * len(np.union1d(a, b)):
                    continue
                both = np.union1d(a, b)
                heavy = both[rng.random(len(both)) < heavy_share]
                key, owner, fringe = jaccard.keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), heavy, t)
                mine, other = ({(int(k), bool(f)) for k, f in zip(key[owner == i], fringe[owner == i], strict=True)} for i in (0, 1))
                shared = {k for k, _ in mine} & {k for k, _ in other}
                assert any(not ((k, True) in mine and (k, True) in other) for k in shared), (size, heavy_share)


def test_histogram_bound_is_a_bound():
    import numpy as np

    rng = np.random.default_rng(1)
    for n in (3, 40, 2000, 12000):
        a = rng.integers(0, 1 << 62, n).astype(np.uint64)
        b = np.concatenate([a[: n * 9 // 10], rng.integers(0, 1 << 62, n // 10).astype(np.uint64)])
        h = jaccard.histograms(np.concatenate([a, b]), np.array([0, n, n + len(b)]))
        x, y = np.hstack([h >> 4, h & 15]).astype(int)
        assert np.minimum(x, y).sum() + min(n - x.sum(), len(b) - y.sum()) >= n * 9 // 10


def test_bytes_against_all_windows(docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    first = {}
    for i, b in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    want = []
    for i, b in rows:
        gone = [False] * len(b)
        for p in range(len(b) - 49) if i is not None else ():
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = [True] * 50
        spans = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        want.append((str(i), len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    got = [(str(r[0]), *r[1:]) for r in substring_bytes.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want)
    assert sum(w[2] for w in want) > 1000


def test_words_against_all_windows(docs):
    rows = [(r.doc_id, words(r.text)) for r in docs.collect()]
    first = {}
    for i, w in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    want = []
    for i, w in rows:
        gone = [False] * len(w)
        for p in range(len(w) - 12) if i is not None else ():
            if first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        want.append((str(i), len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    got = [(str(r[0]), *r[1:]) for r in substring_words.remove_repeats(docs).collect()]
    assert sorted(got) == sorted(want)
    assert sum(w[2] for w in want) > 100


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert jaccard.join(none).collect() == []
    assert substring_bytes.remove_repeats(none).collect() == []
    assert substring_words.remove_repeats(none).collect() == []


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = {r.doc_id: r.component_id for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


def test_difference_cover_aligns_every_pair():
    p, cover = substring_words.PERIOD, substring_words.COVER
    assert all(any((i + k) % p in cover and (j + k) % p in cover for k in range(p)) for i in range(p) for j in range(p))


def test_dedup_ignores_extra_columns(docs):
    assert substring_words.remove_repeats(docs.withColumn("kept_sha256", F.lit(1))).columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
