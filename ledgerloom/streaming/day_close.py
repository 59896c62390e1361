"""Day balances of a stream of statement lines, as they become final: what proof.day_close gives of the whole, one account's state at a time.

A line waits in its account's state until the watermark has passed it, so lines that come late, within the delay, fall in their place. An event-time timer then
settles all lines up to the watermark, in their order: amounts add up, and a closing line gives one row and begins a new day. What is kept of an
account is the lines that wait, the running sum and the last declared balance. Lines later than the delay are Spark's to drop. Needs a session whose
state store is RocksDB (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CLOSINGS = "file_id string, day_no long, moved_cents long, declared_cents long, expected_cents long, agrees boolean"


class DayClose(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at_ms long, line_no long", "is_close boolean, cents long")
        self.day = handle.getValueState("day", "day_no long, moved long, declared long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        due = set()
        for frame in rows:
            for r in frame.itertuples(index=False):
                at = int(r.at.timestamp() * 1000)
                self.waiting.updateValue((at, int(r.line_no)), (bool(r.is_close), int(r.cents)))
                due.add(at)
        for at in due:
            self.handle.registerTimer(at + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        ready = sorted((tuple(k), tuple(v)) for k, v in self.waiting.iterator() if k[0] < now)
        if not ready:  # an earlier timer of this watermark has settled them
            return
        day_no, moved, declared = self.day.get() or (0, 0, None)
        out = []
        for place, (is_close, cents) in ready:
            if is_close:
                expected = None if declared is None else declared + moved
                out.append((key[0], day_no, moved, cents, expected, None if expected is None else expected == cents))
                day_no, moved, declared = day_no + 1, 0, cents
            else:
                moved += cents
            self.waiting.removeKey(place)
        self.day.update((day_no, moved, declared))
        if out:
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in CLOSINGS.split(", ")])
            yield frame.astype({"day_no": "int64", "moved_cents": "int64", "declared_cents": "int64", "expected_cents": "Int64", "agrees": "boolean"})

    def close(self) -> None:
        pass


def closings(lines: DataFrame, late: str = "2 days") -> DataFrame:
    """lines (a stream): file_id, at (timestamp), line_no, is_close, cents (the declared balance of a closing line, else a signed amount).
    A row a closing: day_no, moved, declared and expected balance, agrees; null of both where there is nothing to check it against."""
    timed = lines.selectExpr("cast(file_id AS string) AS file_id", "at", "line_no", "is_close", "cents").withWatermark("at", late)
    return timed.groupBy("file_id").transformWithStateInPandas(DayClose(), CLOSINGS, "Append", "EventTime")
