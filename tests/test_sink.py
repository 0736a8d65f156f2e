"""Report files, written by tasks and joined by the commit."""

import json
import os

import pytest
from pyspark.sql import functions as F

from keelson import report

FINDING = "source string, file string, line int, column int, secret_type string, severity string, hint string, entropy double, suggested_fix string"
ROWS = [("workingTree", "b\"ä.cs", 2, 1, "Token", "high", "k=***", 3.5, "rotate it"), ("workingTree", "a.cs", 9, 4, "ApiKey", "medium", "ApiKey=***", None, None), ("workingTree", "a.cs", 1, 4, "Token", "low", "Token=***", 0.0, "x\ny")]


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], []])
def test_files_are_what_the_texts_are(spark, tmp_path, rows):
    found = spark.createDataFrame(rows, FINDING).repartition(3)
    for text, save in ((report.to_json, report.save_json), (report.to_sarif, report.save_sarif)):
        path = str(tmp_path / "out")
        save(found, path)
        save(found, path)  # a file that is there is replaced
        with open(path, encoding="utf-8") as f:
            assert f.read() == text(found) + "\n"
    assert os.listdir(tmp_path) == ["out"]
    if rows is ROWS:
        body = json.loads(report.to_json(found))
        assert [(r["file"], r["line"]) for r in body["findings"]] == [("a.cs", 1), ("a.cs", 9), ("b\"ä.cs", 2)]
        assert "entropy" not in body["findings"][1] and body["findings"][0]["suggestedFix"] == "x\ny"


def test_many_findings_in_order(spark, tmp_path):
    n = 200_000
    found = spark.range(n).select(F.lit("workingTree").alias("source"), F.format_string("f%07d.cs", F.col("id") * 7919 % n).alias("file"), F.lit(1).alias("line"), F.lit(1).alias("column"), F.lit("Token").alias("secret_type"), F.lit("high").alias("severity"), F.lit("h").alias("hint"), F.lit(1.0).alias("entropy"), F.lit("fix").alias("suggested_fix"))
    report.save_sarif(found, str(tmp_path / "many.sarif"))
    results = json.loads((tmp_path / "many.sarif").read_text())["runs"][0]["results"]
    files = [r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in results]
    assert len(files) == n and files == sorted(files) and files[0] == "f0000000.cs"


def test_a_failed_job_leaves_no_file(spark, tmp_path):
    found = spark.createDataFrame(ROWS, FINDING).withColumn("hint", F.when(F.col("line") == 9, F.raise_error(F.lit("no"))).otherwise(F.col("hint")))
    with pytest.raises(Exception):
        report.save_json(found, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []
