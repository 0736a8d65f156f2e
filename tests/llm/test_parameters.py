"""Bounds that are parameters, queries that share an id, the shared folder."""

import pytest
from pyspark.sql import functions as F

from keelson.llm import common, language, nearest, quality


def test_a_query_id_of_several_rows_asks_with_the_least_vector(spark):
    rows = [(100, [5.0, 1.0]), (100, [1.0, 9.0]), (100, [1.0, 2.0]), (1, [1.0, 2.5]), (2, [5.0, 1.0]), (3, [1.0, 9.0])]
    for n in (1, 3, 6):
        for order in (rows, rows[::-1]):
            table = spark.createDataFrame(order, "vec_id long, embedding array<float>").repartition(n)
            got = nearest.neighbours(table, F.col("vec_id") % 100 == 0, k=2).collect()
            assert [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in sorted(got, key=lambda r: r["rank"])] == [(100, 1, 1, 0.5), (100, 2, 2, round(17**0.5, 6))]


def test_long_labelled_texts_are_a_matter_of_a_parameter(spark):
    rows = [(i, "en" if i % 2 else "fr", ("the and of thing " if i % 2 else "le la eau que ") * (40 if i < 8 else 5)) for i in range(1, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    assert language.learn(docs, longest=1) is None
    assert language.learn(docs, longest=200).languages == ["en", "fr"]
    assert {r.lang_pred for r in language.identify(docs, longest=1).collect()} == {"und"}
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    few, all_of_them = quality.learn(docs, labels, longest=1), quality.learn(docs, labels, longest=10_000)
    assert few is not None and all_of_them is not None
    assert [r.doc_id for r in quality.classify(docs, labels, sample=30, longest=3).orderBy("doc_id").collect()] == list(range(1, 60))


def test_a_cluster_has_to_name_its_shared_folder(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError):
        common.shared_dir(Session())
