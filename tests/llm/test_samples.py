"""Samples for learning: the least hashes, whatever the partitions, and no pile of copies in the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import language, quality
from keelson.llm.common import least


@pytest.mark.parametrize("ids", [range(5000), [7] * 3000 + list(range(40)), range(20), []])
def test_least_is_the_head_of_the_order(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "a long").repartition(7)
    key = F.xxhash64("a")
    want = [r.a for r in df.orderBy(key, "a").limit(50).collect()]
    assert [r.a for r in least(df, key, 50, len(ids), "a")] == want


def test_language_sample_does_not_hang_on_partitions(spark):
    rows = [(i, ["en", "de"][i % 2], f"text {i} " + ["the and of it", "der und die das"][i % 2]) for i in range(900)]
    models = [language.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(n), 40) for n in (1, 9)]
    assert models[0].languages == models[1].languages == ["de", "en"]
    assert np.array_equal(models[0].landmarks, models[1].landmarks) and np.allclose(models[0].weights, models[1].weights)


def test_repeated_ids_are_learnt_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(language, "fit", lambda rows: seen.append(rows))
    rows = [(1, "en", f"copy {i}") for i in range(500)] + [(i, "en", f"text {i}") for i in range(2, 60)]
    language.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    ids = [t for t, _ in seen[0]]
    assert len(ids) == len(set(ids)) <= 59 and sum(t.startswith("copy") for t in ids) <= 1
    monkeypatch.setattr(quality, "fit", lambda bags, y: len(bags))
    docs = spark.createDataFrame([(i, t) for i, _, t in rows] + [(3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    kept = labels.where(~quality.held_out(5, 0)).count()
    assert quality.learn(docs, labels) == kept
