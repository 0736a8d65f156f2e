"""Baselines: known findings that are not reported again."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import SCHEMA_VERSION, TOOL_VERSION
from ..schemas import BASELINE

KEYS = ["file", "line", "secret_type", "hint"]


def load(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a baseline file; none if it is not there."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path):
        return spark.createDataFrame([], "file string, line int, secret_type string, hint string")
    rows = spark.read.schema(BASELINE).option("multiLine", True).json(path)
    return rows.select(F.explode("entries").alias("e")).select("e.file", "e.line", F.col("e.secretType").alias("secret_type"), "e.hint")


def entries(findings: DataFrame) -> DataFrame:
    return findings.select(*KEYS).distinct()


def save(findings: DataFrame, path: str) -> None:
    """Distinct entries as one JSON file, in order, written as they come; folders on the way are made."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'{{\n  "schemaVersion": {json.dumps(SCHEMA_VERSION)},\n  "toolVersion": {json.dumps(TOOL_VERSION)},\n  "entries": [')
        for i, r in enumerate(entries(findings).orderBy(*KEYS).toLocalIterator()):
            entry = {"file": r.file, "line": r.line, "secretType": r.secret_type, "hint": r.hint}
            f.write(("," if i else "") + "\n    " + json.dumps(entry, ensure_ascii=False))
        f.write("\n  ]\n}\n")


def suppress(findings: DataFrame, known: DataFrame) -> DataFrame:
    """Findings that no entry names exactly."""
    return findings.join(known.select(*KEYS).distinct(), KEYS, "left_anti")
