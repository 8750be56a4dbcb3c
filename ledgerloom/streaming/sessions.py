"""Sessions of calls, with late calls kept under a label instead of dropped.

A call is late when it lies more than the delay before the newest call of its
firm that an earlier batch brought. On a stream the newest call is keyed state
and each row leaves with its label; on a stored table the same rule is a running
maximum over batches. Sessions are then cut by firm and label, so a late call
never changes a session that was told already, and no call is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LABELLED = "firm_id long, call_id long, at_us long, late boolean"


def label_late(calls: DataFrame, delay_us: int) -> DataFrame:
    """``calls`` (firm_id, call_id, at_us, batch_no) with ``late``."""
    newest = calls.groupBy("firm_id", "batch_no").agg(F.max("at_us").alias("_newest"))  # a row a firm and batch
    before = newest.select("firm_id", "batch_no", F.max("_newest").over(Window.partitionBy("firm_id").orderBy("batch_no").rowsBetween(Window.unboundedPreceding, -1)).alias("_seen"))
    return calls.join(before, ["firm_id", "batch_no"]).withColumn("late", F.coalesce(F.col("at_us") < F.col("_seen") - delay_us, F.lit(False))).select("firm_id", "call_id", "at_us", "late")


class _Labels(StatefulProcessor):
    def __init__(self, delay_us: int):
        self.delay_us = delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "at_us long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        seen = self.newest.get()[0] if self.newest.exists() else None
        newest = seen
        for r in rows:
            newest = r.at_us if newest is None else max(newest, r.at_us)
            yield Row(firm_id=key[0], call_id=r.call_id, at_us=r.at_us, late=seen is not None and r.at_us < seen - self.delay_us)
        if newest is not None:
            self.newest.update((newest,))

    def close(self) -> None:
        pass


def label_stream(calls: DataFrame, delay_us: int) -> DataFrame:
    """A stream of calls (firm_id, call_id, at_us) with ``late``; the session needs the state store of ``admission.PROVIDER``."""
    rows = calls.select(*[F.col(c).cast("long").alias(c) for c in ("firm_id", "call_id", "at_us")])
    return rows.groupBy("firm_id").transformWithState(_Labels(delay_us), LABELLED, "append", "None")


def sessions(labelled: DataFrame, gap_us: int) -> DataFrame:
    """firm_id, late, start_us, end_us, calls: runs of calls of which each follows the one before it within the gap; a session ends a gap after its last call."""
    w = F.session_window(F.timestamp_micros("at_us"), f"{gap_us} microseconds")
    cut = labelled.groupBy(w.alias("w"), "firm_id", "late").agg(F.count(F.lit(1)).alias("calls"))
    return cut.select("firm_id", "late", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "calls")
