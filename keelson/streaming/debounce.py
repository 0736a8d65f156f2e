"""The live debounce: a timer that each change puts off, kept with the pending paths in the checkpoint."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

GAP_MS = 300
FLUSHED = "path string, at double"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounce(StatefulProcessor):
    """Pending paths, case ignored, and when they are due: gap_ms after the last change.

    A batch lists files after its own time is taken. So when a timer has run out by a batch's
    time, that batch has seen all changes up to then, and has put the timer off if there were any.
    """

    def __init__(self, gap_ms: int = GAP_MS):
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "name string", FLUSHED)
        self.timer = handle.getValueState("timer", "last double, due long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        last = None
        for some in rows:
            for path, at in zip(some["path"], some["at"], strict=True):
                name = (path.lower(),)
                if not self.pending.containsKey(name) or self.pending.getValue(name)[1] <= at:
                    self.pending.updateValue(name, (path, float(at)))
                last = at if last is None else max(last, at)
        if last is not None:
            before = self.timer.get()
            if before is not None:
                last = max(last, before[0])
                self.handle.deleteTimer(before[1])
            due = int(last * 1000) + self.gap_ms
            self.timer.update((float(last), due))
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        rows = [tuple(v) for _, v in self.pending.iterator()]
        self.pending.clear()
        self.timer.clear()
        yield pd.DataFrame(rows, columns=["path", "at"])

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """(path, at) of each path, once a flush. One timer serves all paths, so that all changes are one group; it holds paths only, until the next flush."""
    rows = changes.select(F.lit(0).alias("timer"), "path", "at")
    return rows.groupBy("timer").transformWithStateInPandas(Debounce(gap_ms), FLUSHED, "Append", "ProcessingTime")
