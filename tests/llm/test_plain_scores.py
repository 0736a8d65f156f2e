"""The scores of operators 6 and 8, worked out one text at a time in plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from keelson.llm import language, quality

TEXTS = ["The quick brown fox, and the lazy dog. The quick brown fox!", "", "a", "  \n ", "é à la ü", "x" * 300, "one two three " * 70, "1234 5678; 90", " leading words here\nand a tail\n", "Straße über größte ÄÖÜ", "word " * 95 + "end. next", "word " * 96, None]


def plain_language(model, text):
    marks = [set(np.flatnonzero(m)) for m in np.unpackbits(model.landmarks, axis=1)]
    code = [0x20 if b < 128 and not chr(b).isalpha() else b for b in (text or "").lower().encode()]
    bits = set()
    for n in (1, 2, 3):
        for i in range(len(code) - n + 1):
            gram = 0
            for b in code[i : i + n]:
                gram = gram << 8 | b
            bits.add(((gram + n - 1) * 2654435761 % 2**32) >> 18)
    k = [len(bits & m) / math.sqrt(max(1, len(bits)) * max(1, len(m))) for m in marks] + [1.0]
    return [sum(a * b for a, b in zip(k, column, strict=True)) for column in model.weights.T]


def test_language_scores():
    rng = random.Random(1)
    words = {"en": "the of and to in that is was", "fr": "le de la et les des que une", "de": "der die und das ist nicht ein zu"}
    rows = [(" ".join(rng.choices(w.split(), k=20)), lang) for lang, w in words.items() for _ in range(50)]
    model = language.fit(rows)
    got = model.scores(pa.array([t or "" for t in TEXTS], pa.string()))
    for text, scores in zip(TEXTS, got, strict=True):
        assert np.allclose(scores, plain_language(model, text), atol=1e-4), text
    assert [model.languages[s.argmax()] for s in model.scores(pa.array(["the and that is", "le les des", "nicht und das"]))] == ["en", "fr", "de"]


def plain_passages(text):
    data = (text or "").encode()
    white = b" \t\n\x0b\x0c\r"
    spans, i = [], 0
    while i < len(data):
        if data[i] in white:
            i += 1
            continue
        j = i
        while j < len(data) and data[j] not in white:
            j += 1
        spans.append((i, j))
        i = j
    words = [data[a:b] for a, b in spans]
    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words)))
    groups = [range(a, min(a + quality.PASSAGE, len(words))) for a in range(0, len(words), quality.PASSAGE)] or [range(0)]
    out = []
    for g, group in enumerate(groups):
        begin = 0 if g == 0 else spans[group[0]][0]
        end = len(data) if g == len(groups) - 1 else spans[groups[g + 1][0]][0]
        row = np.zeros(quality.FEATURES)
        size = max(1, end - begin)
        for b in data[begin:end]:
            row[min(quality._CLASS[b], quality.CLASSES - 1)] += 1
        for p in range(begin, min(end, len(data) - 1)):
            row[quality.CLASSES + (((data[p] * 251 + data[p + 1]) * 2654435761 % 2**32) >> 16) % quality.PAIRS] += 1
        row = np.sqrt(row / size)
        if words:
            n, own = max(1, len(group)), [words[i] for i in group]
            wide = [len(w) for w in own]
            mean = sum(wide) / n
            twice = Counter(own)
            row[quality.CLASSES + quality.PAIRS :] = [
                mean / 10,
                math.sqrt(max(0, sum(x * x for x in wide) / n - mean**2)) / 10,
                sum(twice[w] > 1 for w in own) / n,
                sum(triples[tuple(words[i : i + 3])] > 1 for i in group) / n,
                sum(quality._CLASS[w[-1]] > 6 for w in own) / n,
                sum(x > 20 for x in wide) / n,
                math.log1p(n) / 5,
                math.log1p(len(words)) / 10,
            ]
        out.append(row)
    return out


def test_quality_features():
    x, first = quality.encode(pa.array(TEXTS, pa.string()))
    for text, rows in zip(TEXTS, np.split(x, first[1:]), strict=True):
        want = plain_passages(text)
        if not (text or "").split():
            rows, want = rows[:, : quality.CLASSES + quality.PAIRS], [w[: quality.CLASSES + quality.PAIRS] for w in want]
        assert np.allclose(rows, want, atol=1e-5), text


def test_a_score_does_not_depend_on_other_texts():
    together, first = quality.encode(pa.array(TEXTS, pa.string()))
    for text, rows in zip(TEXTS, np.split(together, first[1:]), strict=True):
        alone, _ = quality.encode(pa.array([text], pa.string()))
        if (text or "").split():
            assert np.allclose(alone, rows, atol=1e-6), text


def test_quality_score_is_gated_attention():
    rng = np.random.default_rng(2)
    bags = [rng.normal(size=(n, quality.FEATURES)).astype(np.float32) for n in (1, 3, 2, 5, 1, 4) * 6]
    model = quality.fit(bags, np.arange(len(bags)) % 2)
    size = np.array([len(b) for b in bags])
    got = model.score(np.concatenate(bags).astype(np.float64), np.cumsum(size) - size)
    p, logistic = model.p, lambda v: 1 / (1 + math.exp(-v))
    for bag, score in zip(bags, got, strict=True):
        weights, hidden = [], []
        for x in bag:
            h = [math.tanh(v) for v in ((x - model.mean) / model.scale) @ p["W"] + p["b"]]
            gate = [math.tanh(a) * logistic(b) for a, b in zip(h @ p["V"], h @ p["U"], strict=True)]
            weights.append(math.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
            hidden.append(h)
        z = [sum(w * h[j] for w, h in zip(weights, hidden, strict=True)) / sum(weights) for j in range(len(hidden[0]))]
        assert abs(score - logistic(sum(a * b for a, b in zip(z, p["c"], strict=True)) + float(p["d"][0]))) < 1e-9
