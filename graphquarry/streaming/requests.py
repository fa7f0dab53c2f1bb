"""Requests to index, gathered until a tree is quiet: a burst becomes one batch of its union."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A request: a tree, whether all of it is to be read or built anew, a path that changed (null if none).
REQUEST = "root string, full boolean, rebuild boolean, path string"
BATCH = "root string, number long, full boolean, rebuild boolean, path string"
#: Milliseconds without a request after which a tree's requests are given out.
QUIET_MS = 250


class Gather(StatefulProcessor):
    """What is pending for one tree: flags, the set of paths, and the timer that the last request set anew.

    Paths are a map of their own in the state, so a request adds an entry and
    nothing is rewritten, however many wait.
    """

    def __init__(self, quiet_ms: int = QUIET_MS):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flags = handle.getValueState("flags", "full boolean, rebuild boolean")
        self.timer = handle.getValueState("timer", "at long")
        self.number = handle.getValueState("number", "n long")
        self.paths = handle.getMapState("paths", "path string", "there boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        full, rebuild = self.flags.get() if self.flags.exists() else (False, False)
        for row in rows:
            full, rebuild = full or bool(row["full"]), rebuild or bool(row["rebuild"])
            if row["path"] is not None:
                self.paths.updateValue((row["path"],), (True,))
        self.flags.update((full, rebuild))
        if self.timer.exists():
            self.handle.deleteTimer(self.timer.get()[0])
        at = timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms
        self.timer.update((at,))
        self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        full, rebuild = self.flags.get()
        number = self.number.get()[0] + 1 if self.number.exists() else 0
        paths = [k[0] for k in self.paths.keys()] or [None]
        self.paths.clear()
        self.flags.clear()
        self.timer.clear()
        self.number.update((number,))
        for path in paths:
            yield Row(root=key[0], number=number, full=full or rebuild, rebuild=rebuild, path=path)

    def close(self) -> None:
        pass


def gathered(requests: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """A stream of batches ``(root, number, full, rebuild, path)`` from a stream of :data:`REQUEST` rows.

    A tree's requests wait until none came for ``quiet_ms``; then they come out
    once: a row for each different path (one without a path if there is none),
    all with the batch's number and the union of its flags; a rebuild reads
    everything. Requests that come later make the next batch. Rows without a
    root are left out. The session's state store has to be the one with RocksDB.
    """
    asked = requests.select("root", "full", "rebuild", "path").filter("root is not null")
    return asked.groupBy("root").transformWithState(statefulProcessor=Gather(quiet_ms), outputStructType=BATCH, outputMode="Append", timeMode="ProcessingTime")
