"""The stages of the pipeline, each against a plain version of what it decides."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from test_scores_and_scans import brute_matches

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark):
    """The input of each stage and the result of the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("__x", F.lit(1))
    extra = spark.createDataFrame([(90001, None), (90002, "123 !!"), (90003, 'secret = "Zx9" and token = "abcdef123456"')], "doc_id long, text string")
    docs = docs.unionByName(extra.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("__x")))
    out = [P.stored(docs, "input")]
    for name, stage in P.STAGES:
        out.append(P.stored(stage(spark, out[-1], SF), name))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(kept):
    assert all(k.columns == kept[0].columns for k in kept[1:5]) and "copies" in kept[5].columns
    assert [n for n, _ in P.STAGES] == ["language_id", "near_duplicates", "decontamination", "secret_scan", "mixture"]


def test_language(kept):
    before, after = rows(kept[0]), rows(kept[1])
    assert set(before) - set(after) == {i for i, r in before.items() if not any(map(str.isalpha, r.text or ""))} >= {90001, 90002}


def test_near_duplicates(kept):
    sets = {}
    for i, r in rows(kept[1]).items():
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text)) if x]
        sets[i] = {tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))} if w else set()
    group = {i: {i} for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[b]:
                    group[x] = group[a]
    assert set(rows(kept[2])) == {min(g) for g in group.values()}


def test_decontamination(spark, kept):
    before = rows(kept[2])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(before) - set(rows(kept[3])) == {d for d, _ in brute_matches(items, [(i, r.text) for i, r in before.items()])}


def test_secrets(kept):
    before, after = rows(kept[3]), rows(kept[4])
    assert set(before) == set(after)
    pattern = re.compile(r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{6,}|[0-9a-f]{24,}", re.A)
    for i, r in before.items():
        if pattern.search(r.text):
            assert not pattern.search(after[i].text) and "[secret]" in after[i].text
        else:
            assert after[i].text == r.text
        assert after[i].n_chars == len(after[i].text)
    assert after[90003].text == 'secret = "Zx9" and [secret]"'


def test_mixture(kept):
    before, after = rows(kept[4]), rows(kept[5])
    assert set(before) == set(after) and sum(r.copies for r in after.values()) > 0
