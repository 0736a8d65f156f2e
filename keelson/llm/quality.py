"""Quality classifier by attention-based multiple-instance learning (operator 6).

A document is a bag of passages of PASSAGE words. Every passage of every text is encoded:
byte classes, punctuation and byte pairs (hashed), word lengths, and how many of its words
and word triples stand elsewhere in the document. A hidden layer maps a passage to h; gated
attention, softmax of w . (tanh(V h) * sigmoid(U h)) over the passages of a document, weighs
them; the weighted sum gives the score. Labels are those of documents; attention is learnt
from them alone. Learning (Adam, a fixed seed, on the driver) takes at most SAMPLE labelled
rows with crc32(doc_id) modulo 5 not 0: those of the least hashes of doc_id. Of a text of
the sample with more than LONGEST passages that many, evenly spaced, are learnt from (both are
parameters of learn; they bound what the driver holds); scores always take all passages.

Score and passages depend on the text only. Empty and null texts have one passage of zeros.
Very long texts are worked through whole. A null doc_id is scored (held_out null). Repeated
rows and extra columns make no difference: of an id with several texts the least one is learnt from,
so that the driver gets no more than SAMPLE texts; a document whose labels contradict each other counts
as good. An empty table gives an empty result; without labels of both kinds, or without
labelled documents, all scores are 0.5.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import least, passes, run_lengths, runs, tune
from .kernels import Rolling, flat, owners, word_hashes, words
from .language import held_out

PASSAGE, SAMPLE, HIDDEN, GATE, EPOCHS = 96, 3000, 32, 16, 24
PAIRS = 96
THRESHOLD = 0.3
#: Passages of a labelled text that are learnt from.
LONGEST = 256
_CLASS = np.full(256, 20, np.int64)
_CLASS[48:58] = 0
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[32] = 3
_CLASS[10] = 4
_CLASS[128:192] = 5
_CLASS[192:] = 6
for _i, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"):
    _CLASS[_c] = 7 + _i
CLASSES = 7 + 32
FEATURES = CLASSES + PAIRS + 8


def repeats(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Which (group, value) rows occur more than once."""
    order = np.lexsort((value, group))
    begin = runs(group[order], value[order])
    many = np.repeat(run_lengths(begin, len(order)) > 1, run_lengths(begin, len(order)))
    out = np.zeros(len(order), bool)
    out[order] = many
    return out


def encode(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and for each document its first passage."""
    buf, offsets = flat(text)
    starts, ends, first = words(buf, offsets)
    n = np.diff(first)
    count = np.maximum(1, -(-n // PASSAGE))
    bags = np.concatenate([[0], np.cumsum(count)])
    total = int(bags[-1])
    out = np.zeros((total, FEATURES), np.float32)
    doc = owners(first)
    at = bags[:-1][doc] + (np.arange(len(starts)) - first[:-1][doc]) // PASSAGE
    # Bytes belong to the passage of the word before them
    cut = np.zeros(len(buf) + 1, np.int64)
    opening = np.flatnonzero(np.diff(at, prepend=-1)) if len(at) else np.zeros(0, np.int64)
    cut[offsets[:-1]] = 1
    inner = opening[first[:-1][doc[opening]] != opening] if len(opening) else opening
    cut[starts[inner]] = 1
    size = np.diff(offsets)
    if len(buf):
        # a document's first byte opens its first passage; empty documents are skipped by name
        where = np.flatnonzero(cut[:-1])
        label = np.full(len(where), -1)
        filled = np.flatnonzero(size > 0)
        pos = np.searchsorted(where, offsets[:-1][filled])
        label[pos] = bags[:-1][filled]
        rest = label < 0
        label[rest] = at[inner]
        name = np.repeat(label, np.diff(np.append(where, len(buf))))
        length = np.maximum(np.bincount(name, minlength=total), 1)
        out[:, :CLASSES] = (np.bincount(name * CLASSES + np.minimum(_CLASS[buf], CLASSES - 1), minlength=total * CLASSES).reshape(total, -1) / length[:, None]) ** 0.5
        pair = (buf[:-1].astype(np.uint32) * np.uint32(251) + buf[1:]) * np.uint32(2654435761)
        pair = ((pair >> np.uint32(16)) % np.uint32(PAIRS)).astype(np.int64)
        # The last byte of a text and the first of the next are no pair
        own = np.ones(len(pair), bool)
        edge = offsets[1:-1]
        own[edge[(edge > 0) & (edge < len(buf))] - 1] = False
        out[:, CLASSES : CLASSES + PAIRS] = (np.bincount((name[:-1] * PAIRS + pair)[own], minlength=total * PAIRS).reshape(total, -1) / length[:, None]) ** 0.5
    if len(starts):
        many = np.maximum(np.bincount(at, minlength=total), 1)
        wide = (ends - starts).astype(np.float64)
        hashes = word_hashes(buf, starts, ends)
        mean = np.bincount(at, wide, minlength=total) / many
        triple = Rolling(hashes)
        last = first[1:][doc]
        again = repeats(doc, triple.of(np.arange(len(starts)), np.minimum(np.arange(len(starts)) + 3, last)))
        tail = _CLASS[buf[ends - 1]]
        rows = (
            mean / 10,
            np.sqrt(np.maximum(np.bincount(at, wide**2, minlength=total) / many - mean**2, 0)) / 10,
            np.bincount(at, repeats(at, hashes), minlength=total) / many,
            np.bincount(at, again, minlength=total) / many,
            np.bincount(at, tail > 6, minlength=total) / many,
            np.bincount(at, wide > 20, minlength=total) / many,
            np.log1p(many) / 5,
            np.log1p(n)[np.repeat(np.arange(len(n)), count)] / 10,
        )
        out[:, CLASSES + PAIRS :] = np.stack(rows, 1)
    return out, bags[:-1]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray):
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
        e = (v * u) @ p["w"]
        bag = np.repeat(np.arange(len(first)), run_lengths(first, len(x)))
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        a = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(a[:, None] * h, first)
        return x, h, v, u, bag, a, z, sigmoid(z @ p["c"] + p["d"])

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(x, first)[-1]

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        x, h, v, u, bag, a, z, s = self.forward(x, first)
        ds = (s - y) * weight / len(y)
        dz = ds[:, None] * p["c"]
        da = (h * dz[bag]).sum(1)
        de = a * (da - np.add.reduceat(a * da, first)[bag])
        dg = de[:, None] * p["w"]
        dv, du = dg * u * (1 - v**2), dg * v * u * (1 - u)
        dh = a[:, None] * dz[bag] + dv @ p["V"].T + du @ p["U"].T
        dh *= 1 - h**2
        return {"c": z.T @ ds, "d": ds.sum(keepdims=True), "w": (v * u).T @ de, "V": h.T @ dv, "U": h.T @ du, "W": x.T @ dh, "b": dh.sum(0)}


def fit(bags: list[np.ndarray], y: np.ndarray, seed: int = 11) -> Model | None:
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    everything = np.concatenate(bags).astype(np.float64)
    shape = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in "bd" else np.zeros(s) for k, s in shape.items()}
    model = Model(everything.mean(0), everything.std(0) + 1e-2, p)
    m1, m2 = ({k: np.zeros(s) for k, s in shape.items()} for _ in range(2))
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum())) ** 0.5
    step = 0
    for epoch in range(EPOCHS):
        for chosen in np.array_split(rng.permutation(len(bags)), max(1, len(bags) // 64)):
            x = np.concatenate([bags[i] for i in chosen]).astype(np.float64)
            size = np.array([len(bags[i]) for i in chosen])
            g = model.gradient(x, np.cumsum(size) - size, y[chosen].astype(float), weight[chosen])
            step += 1
            rate = 4e-3 * (1 - epoch / EPOCHS) + 2e-4
            for k in p:
                grad = g[k] + 1e-4 * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad**2
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, longest: int = LONGEST) -> Model | None:
    own = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(~held_out(5, 0) & F.col("quality").isin(0, 1))
    own = own.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = {r.doc_id: r.quality for r in least(own, F.xxhash64("doc_id"), sample, labels.count(), "doc_id")}
    if not chosen:
        return None

    @F.arrow_udf("binary")
    def bag(text: pa.Array) -> pa.Array:
        out = []
        for a, b in passes(text):
            x, first = encode(text.slice(a, b - a))
            out += [bag[np.linspace(0, len(bag) - 1, min(len(bag), longest)).astype(int)].tobytes() for bag in np.split(x, first[1:])]
        return pa.array(out, pa.binary())

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.col("doc_id").isin(list(chosen)))
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"))  # an id that many rows repeat is learnt once
    rows = sorted((r.doc_id, bytes(r.bag)) for r in texts.select("doc_id", bag("text").alias("bag")).collect())
    return fit([np.frombuffer(b, np.float32).reshape(-1, FEATURES) for _, b in rows], np.array([chosen[i] for i, _ in rows])) if rows else None


def scored(model: Model | None):
    @F.arrow_udf("double")
    def run(text: pa.Array) -> pa.Array:
        out = np.full(len(text), 0.5)
        if model is not None:
            for a, b in passes(text):
                out[a:b] = model.score(*encode(text.slice(a, b - a)))
        return pa.array(out)

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, longest: int = LONGEST) -> DataFrame:
    """doc_id, held_out, score and prediction of every document. sample, longest: labelled texts, and passages of one of them, that are learnt from."""
    tune(docs.sparkSession)
    model = learn(docs, labels, sample, longest)
    x = docs.select("doc_id", held_out(5, 0).alias("held_out"), scored(model)(F.col("text").cast("string")).alias("score"))
    return x.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
