"""Language identification with string kernels (operator 8).

The kernel is the blended spectrum of presence: of two texts, the byte n-grams (n = 1, 2, 3,
in lower case, all but letters as a space, hashed to DIMENSIONS places) that both have,
divided by the root of the product of how many each has. Landmarks, drawn from the learning
rows, give the Nystroem map; one-versus-rest kernel ridge regression on it comes down to one
matrix, by which batches of kernel rows are multiplied. What is learnt is a landmark bitmap
and that matrix, whatever the size of the table.

Learning takes at most PER_LANGUAGE rows of each language (the least hashes of doc_id among
rows whose crc32(doc_id) modulo 4 is not 2, with text of at most 64 KB); prediction takes
whole texts, and nothing but the text. Texts that are null or have no letter give `und` and
score 0; so does any text if there is nothing to learn from. A null doc_id is predicted, too
(held_out is null). Of an id with several texts in one language the least is learnt from, so
that repeated ids do not pile up in the driver. Extra columns make no difference; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import passes, tune
from .kernels import flat

DIMENSIONS = 1 << 14
GRAMS = (1, 2, 3)
PER_LANGUAGE, LANDMARKS, RIDGE = 300, 40, 0.3
#: Bytes of a labelled text; longer ones are not learnt from, but predicted like the others.
LONGEST = 1 << 16
#: The sample's first step deals rows by the number of their partition modulo this.
LOTS = 64
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def presence(text: pa.Array) -> np.ndarray:
    """A row of zeros and ones for each text."""
    buf, offsets = flat(pc.utf8_lower(text.fill_null("")))
    code = _LETTER[buf].astype(np.uint32)
    n = len(offsets) - 1
    out = np.zeros((n, DIMENSIONS), np.uint8)
    doc = np.repeat(np.arange(n, dtype=np.int64) * DIMENSIONS, np.diff(offsets))
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(buf))
    gram = np.zeros(len(code), np.uint32)
    for k in range(max(GRAMS)):
        gram = (gram[: len(code) - k] << np.uint32(8)) | code[k:]
        if k + 1 in GRAMS and len(gram):
            place = (((gram + np.uint32(k)) * np.uint32(2654435761)) >> np.uint32(32 - 14)).astype(np.int64) + doc[: len(gram)]
            out.ravel()[place[left[: len(gram)] > k]] = 1
    return out


def lettered(text: pa.Array) -> np.ndarray:
    """Which texts have a letter."""
    some = np.array(pc.fill_null(pc.match_substring_regex(text, "[A-Za-z]"), False), dtype=bool)
    for i in np.flatnonzero(~some & np.asarray(text.is_valid())).tolist():
        some[i] = any(map(str.isalpha, text[i].as_py()))
    return some


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray  # bits
    weights: np.ndarray

    def kernel(self, x: np.ndarray, marks: np.ndarray) -> np.ndarray:
        k = x.astype(np.float32) @ marks.T
        return k / np.sqrt(np.maximum(x.sum(1, dtype=np.int64), 1)[:, None] * np.maximum(marks.sum(1), 1)[None, :])

    def scores(self, text: pa.Array) -> np.ndarray:
        marks = np.unpackbits(self.landmarks, axis=1).astype(np.float32)
        out = [np.zeros((0, len(self.languages)))]
        for a in range(0, len(text), 128):
            k = self.kernel(presence(text.slice(a, min(128, len(text) - a))), marks)
            out.append(np.hstack([k, np.ones((len(k), 1))]) @ self.weights)
        return np.concatenate(out)


def fit(rows: list[tuple[str, str]], seed: int = 5) -> Model | None:
    """From (text, language)."""
    languages = sorted({lang for _, lang in rows})
    if not rows:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([languages.index(lang) for _, lang in rows])
    chosen = np.concatenate([rng.permutation(np.flatnonzero(y == c))[:LANDMARKS] for c in range(len(languages))])
    bits = np.concatenate([np.packbits(presence(pa.array([rows[i][0] for i in chosen[a : a + 128]], pa.string())), axis=1) for a in range(0, len(chosen), 128)])
    model = Model(languages, bits, np.zeros((0, 0)))
    marks = np.unpackbits(bits, axis=1).astype(np.float32)
    texts = pa.array([r[0] for r in rows], pa.string())
    k = np.concatenate([model.kernel(presence(texts.slice(a, 128)), marks) for a in range(0, len(rows), 128)])
    value, vector = np.linalg.eigh(k[chosen])
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    phi = np.hstack([k @ root, np.ones((len(k), 1))])
    balance = 1 / np.bincount(y, minlength=len(languages))[y]
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    gram = phi.T @ (phi * balance[:, None])
    reg = RIDGE * np.eye(len(gram)) / max(1, len(chosen))
    reg[-1, -1] = 1e-6
    w = np.linalg.solve(gram + reg, phi.T @ (target * balance[:, None]))
    model.weights = np.vstack([root @ w[:-1], w[-1:]])
    return model


def held_out(modulus: int, rest: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == rest


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> Model | None:
    """From at most per_language labelled rows of each language, none of more than longest bytes."""
    own = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    own = own.where(~held_out(4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= longest))
    few = own.select("doc_id", "lang", (F.spark_partition_id() % LOTS).alias("lot"))
    for part in (["lang", "lot"], ["lang"]):  # the least of each lot first: no task takes rows of all partitions
        order = Window.partitionBy(*part).orderBy(F.xxhash64("doc_id"), "doc_id")
        few = few.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).drop("n")
    ids = sorted({r[0] for r in few.select("doc_id").collect()})
    if not ids:
        return None
    rows = own.where(F.col("doc_id").isin(ids)).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    return fit([(r.text, r.lang) for r in sorted(rows, key=lambda r: (r.doc_id, r.lang, r.text))])


def predicted(model: Model | None):
    @F.arrow_udf("lang_pred string, score double")
    def run(text: pa.Array) -> pa.Array:
        some = lettered(text)
        lang = np.full(len(text), "und", object)
        score = np.zeros(len(text))
        if model is not None and some.any():
            for a, b in passes(text):
                s = model.scores(text.slice(a, b - a))
                best = s.argmax(1)
                lang[a:b] = np.array(model.languages, object)[best]
                score[a:b] = np.clip((s.max(1) + 1) / 2, 0, 1)
        lang[~some], score[~some] = "und", 0.0
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score)], names=["lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None = None, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    tune(docs.sparkSession)
    model = model or learn(docs, per_language, longest)
    x = docs.select("doc_id", held_out(4, 2).alias("held_out"), predicted(model)(F.col("text").cast("string")).alias("x"))
    return x.select("doc_id", "held_out", "x.lang_pred", "x.score")
