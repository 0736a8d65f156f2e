"""Reports as files: tasks write parts, the commit joins them.

A part holds the findings of one task as JSON, in the order of its rows; parts go in the order of
tasks, so that findings that are sorted before stay so. The joined file takes its place in one
step; a job that fails leaves none. Parts lie beside the file, in a folder that all tasks have to
see. What commit holds is a name for each part, and a buffer.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from .shared import workers_find_package

MARK = "@findings@"


@dataclass
class Part(WriterCommitMessage):
    order: int
    name: str
    findings: int


@dataclass
class Frame:
    """What stands around the findings of a report, and between them."""

    head: str
    tail: str
    margin: str
    empty: str

    @staticmethod
    def of(body: Callable[[list], dict]) -> Frame:
        """From the report with a list of findings."""
        text = json.dumps(body([MARK]), indent=2, ensure_ascii=False)
        head, tail = text.split(json.dumps(MARK))
        return Frame(head, tail, head[head.rindex("\n") :], json.dumps(body([]), indent=2, ensure_ascii=False))

    def shown(self, item: dict[str, Any]) -> str:
        return json.dumps(item, indent=2, ensure_ascii=False).replace("\n", self.margin)


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, path: str, frame: Frame):
        self.path, self.frame = path, frame
        self.folder = f"{path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        os.makedirs(self.folder, exist_ok=True)
        task = TaskContext.get()
        name, n = f"{task.partitionId():08d}-{task.taskAttemptId()}", 0
        with open(os.path.join(self.folder, name), "w", encoding="utf-8") as f:
            for b in iterator:
                for text in b.column(0).to_pylist():
                    f.write(("," + self.frame.margin if n else "") + self.frame.shown(json.loads(text)))
                    n += 1
        return Part(task.partitionId(), name, n)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.findings), key=lambda m: m.order)
        whole = f"{self.folder}.joined"
        with open(whole, "wb") as out:
            out.write((self.frame.head if parts else self.frame.empty).encode())
            for i, part in enumerate(parts):
                out.write(("," + self.frame.margin).encode() if i else b"")
                with open(os.path.join(self.folder, part.name), "rb") as f:
                    shutil.copyfileobj(f, out)
            out.write((self.frame.tail if parts else "").encode() + b"\n")
        os.replace(whole, self.path)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class ReportSink(DataSource):
    @classmethod
    def name(cls):
        return "keelson_report"

    def writer(self, schema, overwrite):
        return ReportWriter(self.options["path"], Frame(**json.loads(self.options["frame"])))


def save(items: DataFrame, path: str, body: Callable[[list], dict]) -> None:
    """A report file from a table with one column, the JSON text of a finding, in order."""
    spark = items.sparkSession
    workers_find_package(spark)
    spark.dataSource.register(ReportSink)
    frame = json.dumps(Frame.of(body).__dict__)
    items.write.format("keelson_report").option("frame", frame).mode("append").save(os.path.abspath(path))
