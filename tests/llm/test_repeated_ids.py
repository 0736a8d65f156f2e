"""Rows that repeat a doc_id with other texts, words that cancelled out in a polynomial hash, hot triggers."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from keelson.llm import jaccard, kernels, substring_bytes, substring_words

KIND = "doc_id long, text string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))


T, U = prose(1, 200), prose(2, 200)
NEAR = T.replace(T.split()[100], "other")


def spaced(rows):
    """Of each row the bytes that stay, by brute force."""
    first = {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    out = []
    for i, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        out.append((i, len(b), sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out)


def kept_words(rows):
    first = {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        w = t.split()
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    out = []
    for i, t in rows:
        w = t.split()
        gone = [False] * len(w)
        for p in range(len(w) - 12):
            if first[tuple(w[p : p + 13])] < i:
                gone[p : p + 13] = [True] * 13
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 4])
def test_one_id_with_several_texts(spark, parts):
    rows = [(1, T), (2, U), (2, T), (2, "short"), (2, U[:400] + T[:400]), (3, U), (3, T)]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, KIND).repartition(parts)
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in substring_bytes.remove_repeats(docs).collect()) == spaced(rows)
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_words.remove_repeats(docs).collect()) == kept_words(rows)


@pytest.mark.parametrize("third", ["three unrelated words", prose(9, 900)])
def test_links_of_every_text_of_an_id(spark, third):
    rows = [(1, T), (2, NEAR), (2, third)]
    for order in (rows, rows[::-1]):
        got = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(order, KIND)).collect()}
        assert got == {1: 1, 2: 1}


def test_hashes_of_words_that_cancel_out():
    def thue(n, a, b):
        while len(a) < n:
            a, b = a + b, b + a
        return a

    for n in (8, 64, 1024, 2048, 4096):
        buf, offsets = kernels.flat(pa.array([thue(n, "a", "b"), thue(n, "b", "a")]))
        starts, ends, _ = kernels.words(buf, offsets)
        assert len(set(kernels.word_hashes(buf, starts, ends).tolist())) == 2


def test_hashes_of_words_of_all_lengths_differ_and_depend_on_the_word_alone():
    words = [("x" * k)[:-1] + c for k in range(1, 200) for c in "ab"]
    buf, offsets = kernels.flat(pa.array([" ".join(words), " " + "\n".join(reversed(words))]))
    starts, ends, first = kernels.words(buf, offsets)
    h = kernels.word_hashes(buf, starts, ends)
    assert len(set(h.tolist())) == len(words)
    assert h[: first[1]].tolist() == h[first[1] :][::-1].tolist()


def test_suffix_array_is_the_order_of_suffixes():
    rng = np.random.default_rng(3)
    for depth in (5, 8, 13, 50):
        size = rng.integers(depth, depth + 60, 40)
        text = rng.integers(97, 99, size.sum()).astype(np.uint8)
        text[size[0] : 2 * size[0]] = text[: size[0]]
        at, begin = substring_bytes.suffix_array(text, size, depth)
        got = [text[p : p + depth].tobytes() for p in at]
        assert got == sorted(got) and len(got) == (size - depth + 1).sum()
        assert [i for i, s in enumerate(got) if not i or s != got[i - 1]] == begin.tolist()


def test_triggers_with_more_phrases_than_are_sorted_together(spark, monkeypatch):
    """A line that all documents hold among other words: phrases at its ends are all different."""
    line = "a line of more than fifty bytes that stands in every document of this table"
    rows = [(i, f"{prose(i, 9)} {line} {prose(1000 + i, 9)} {line}{prose(i % 5, 12)}") for i in range(80)]
    want = spaced(rows)
    for few, limit in ((1, 1), (2, 8), (8, 1024), (64, 30)):
        scheme = substring_bytes.Phrases()
        scheme.few, scheme.limit = few, limit
        docs = spark.createDataFrame(rows, KIND).repartition(5)
        got = substring_bytes.removal(docs, scheme, substring_bytes.kept(scheme), substring_bytes.SCHEMA).collect()
        assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(w[2] for w in want) > 5000
