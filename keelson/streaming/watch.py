"""Watch mode: a stream of file changes, scanned anew flush by flush."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..catalogue import Detector
from ..operators.findings import working_tree
from ..sources.tree import ScanOptions
from .changes import changes, opened
from .debounce import GAP_MS, PROVIDER, debounced

#: How often folders are listed.
EVERY = "100 milliseconds"


def watch(spark: SparkSession, root: str, detectors: tuple[Detector, ...], report: Callable[[DataFrame], None], checkpoint: str, since_ns: int | None = None, once: bool = False, failed: Callable[[str], None] = print, options: ScanOptions | None = None, gap_ms: int = GAP_MS) -> StreamingQuery:
    """Reports the findings of changed files that the options have in scope, gap_ms after the last change.

    Each path once a flush; files that are gone by then are left out. Pending paths are in the
    checkpoint: a restart loses none. A flush that fails names the kind of error only and does not
    end the watch. once: what has changed up to now, without waiting for a gap.
    """
    own = spark.newSession()  # its settings are the watch's own
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", "1")  # one timer: one group

    def flush(batch: DataFrame, _: int) -> None:
        try:
            paths = batch.select("path").dropDuplicates()
            if not paths.isEmpty():
                report(working_tree(opened(paths, os.path.abspath(root)), detectors))
        except Exception as e:  # noqa: BLE001
            failed(type(e).__name__)

    seen = changes(own, root, f"{checkpoint}/manifests", since_ns, options)
    out = (seen if once else debounced(seen, gap_ms)).writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime=EVERY)).start()
