"""Run headers, endpoint books, dirty-set upkeep and start-up checks."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


HEADER = "run_id int, state string, counters string, phases_ms string"


def run_header(spark: SparkSession, run_id: int, state: str, counters: dict[str, int], phases_ms: dict[str, int]) -> DataFrame:
    """One row: counters and phase timings as JSON with sorted keys."""
    return spark.createDataFrame([(run_id, state, json.dumps(counters, sort_keys=True), json.dumps(phases_ms, sort_keys=True))], HEADER)


class Run:
    """A run with its phases timed: RUNNING inside the ``with`` block, then COMPLETED, or FAILED if it raised.

    >>> with Run(spark, 7) as run:
    ...     with run.phase("merge"):
    ...         run.count(inserted=n)
    """

    def __init__(self, spark: SparkSession, run_id: int):
        self.spark, self.run_id, self.state = spark, run_id, "NEW"
        self.counters: dict[str, int] = {}
        self.phases_ms: dict[str, int] = {}

    def __enter__(self) -> Run:
        self.state = "RUNNING"
        return self

    def __exit__(self, kind, value, trace) -> None:
        self.state = "COMPLETED" if kind is None else "FAILED"

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        """Adds what the block took, whether it ends well or not."""
        began = time.monotonic()
        try:
            yield
        finally:
            self.phases_ms[name] = self.phases_ms.get(name, 0) + round(1000 * (time.monotonic() - began))

    def count(self, **counters: int) -> None:
        self.counters.update(counters)

    def header(self) -> DataFrame:
        return run_header(self.spark, self.run_id, self.state, self.counters, self.phases_ms)


def book_submissions(book: DataFrame, sent: DataFrame) -> DataFrame:
    """Submissions are inserted if their key is absent."""
    return book.unionByName(sent.join(book.select("idempotency_key"), "idempotency_key", "left_anti").dropDuplicates(["idempotency_key"]))


def book_filings(book: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded filings are appended without uniqueness, so that a duplicate stays visible."""
    return book.unionByName(recorded)


def clear_dirty(dirty: DataFrame, processed: DataFrame) -> DataFrame:
    """Dirty units less exactly those that were processed: same firm, client and year, marked no later than the run's watermark."""
    p = processed.select("firm_id", "client_id", "tax_year", "watermark")
    return dirty.join(p, ["firm_id", "client_id", "tax_year"], "left").filter("watermark is null or marked_at > watermark").drop("watermark")


def catalog(tables: dict[str, Callable[[], DataFrame]], shared: frozenset[str]) -> list[tuple[str, bool, bool]]:
    """(table, has a firm column, is shared): the facts that the start-up check rests on."""
    return [(n, "firm_id" in f().columns, n in shared) for n, f in sorted(tables.items())]
