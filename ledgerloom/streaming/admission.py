"""Rate admission on a stream: a firm's last grants and its calls that wait are keyed state.

Admission goes by event time, yet calls come in any order within the watermark's
delay. A call waits in its firm's state until the watermark has passed it; a
timer then admits all that are due, in order, exactly as ``filings.admit`` does.
What is kept of a firm is its last ``limit`` grants and the calls of the delay.
Calls that come later than the delay are dropped, as the watermark says.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ADMITTED = "firm_id long, call_id long, granted boolean, retry_at_us long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def admit_in_order(calls: list[tuple[int, int]], held: list[int], window_us: int, limit: int) -> tuple[list[tuple[int, bool, int | None]], list[int]]:
    """((call_id, granted, retry_at_us) of calls (at_us, call_id) in order, the grants still held)."""
    out = []
    for at, call in calls:
        held = [t for t in held if t > at - window_us]
        granted = len(held) < limit
        out.append((call, granted, None if granted else held[0] + window_us))
        if granted:
            held.append(at)
    return out, held


class Admission(StatefulProcessor):
    def __init__(self, window_us: int, limit: int):
        self.window_us, self.limit = window_us, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "at_us array<long>, call_id array<long>")
        self.granted = handle.getValueState("granted", "at_us array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.waiting.get() if self.waiting.exists() else ([], [])
        at, calls = list(kept[0]), list(kept[1])
        for r in rows:
            at.append(r.at_us)
            calls.append(r.call_id)
        self.waiting.update((at, calls))
        self.handle.registerTimer(min(at) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.waiting.exists():
            return
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(zip(*self.waiting.get(), strict=True))
        due, later = [w for w in waiting if w[0] < passed], [w for w in waiting if w[0] >= passed]
        held = list(self.granted.get()[0]) if self.granted.exists() else []
        admitted, held = admit_in_order(due, held, self.window_us, self.limit)
        self.granted.update((held,))
        if later:
            self.waiting.update(([t for t, _ in later], [c for _, c in later]))
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        for call, granted, retry in admitted:
            yield Row(firm_id=key[0], call_id=call, granted=granted, retry_at_us=retry)

    def close(self) -> None:
        pass


def admit_stream(calls: DataFrame, window_us: int, limit: int, late: str = "10 minutes") -> DataFrame:
    """firm_id, call_id, granted, retry_at_us of a stream of calls (firm_id, call_id, at_us), once the watermark has passed them. The session needs ``PROVIDER`` as its state store."""
    rows = calls.select(*[F.col(c).cast("long").alias(c) for c in ("firm_id", "call_id", "at_us")]).withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", late)
    return rows.groupBy("firm_id").transformWithState(Admission(window_us, limit), ADMITTED, "append", "EventTime")
