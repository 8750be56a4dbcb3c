"""Shared plumbing of the training-data operators.

* ``docs_of`` narrows an input to the columns an operator needs, so further
  columns (clashing names included) never reach its joins.
* ``keep`` writes an intermediate table to the folder that all executors share
  and reads it back: lineage is cut by a durable file, so a lost executor costs
  a re-read, never a recomputation of everything before it.
* ``release`` lets Spark drop the shuffle files of finished steps.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Documents are long rows: where the session leaves Spark's 10,000 rows an Arrow batch, batches get ``rows``, so that a task's buffers stay at a few MB on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name, "10000") == "10000":
        spark.conf.set(name, str(rows))


def docs_of(df: DataFrame) -> DataFrame:
    """(doc_id, text) with a null text read as empty."""
    small_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: What reused Python workers keep between tasks, by owner: a function that forgets it.
CACHES: dict[str, Callable[[], None]] = {}


def arrow_map(df: DataFrame, run: Callable, schema, owner: str | None = None) -> DataFrame:
    """``df.mapInArrow`` whose worker first forgets what other owners keep, and afterwards gives freed memory back to the system: workers are reused from task to task and stage to stage."""

    def lean(batches: Iterator) -> Iterator:
        forget_others(owner)
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)


def forget_others(owner: str | None) -> None:
    for name, forget in CACHES.items():
        if name != owner:
            forget()


def give_back() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def rowed(df: DataFrame) -> DataFrame:
    """(_row, doc_id, text): every column but the text in one struct, which passes an Arrow function untouched whatever its names are."""
    small_batches(df.sparkSession)
    rest = [F.col(f"`{c}`") for c in df.columns if c != "text"]
    return df.select(F.struct(*rest).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def unrowed(df: DataFrame, columns: list[str]) -> DataFrame:
    """The ``columns`` of the frame that ``rowed`` was given, in their order."""
    return df.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in columns])


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A local session that names none (tests) gets a temporary one; on a cluster that is an error, as no other machine would see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='ledgerloom-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Tables made by ``keep`` within ``kept_within``, innermost last.
_scopes: list[list[DataFrame]] = []


@contextmanager
def kept_within() -> Iterator[None]:
    """Deletes at its end what ``keep`` wrote inside: for callers who have written their own result by then."""
    _scopes.append([])
    try:
        yield
    finally:
        discard(*_scopes.pop())


def keep(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder once and return the written table; a ``lasting`` one outlives ``kept_within``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    if _scopes and not lasting:
        _scopes[-1].append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``keep`` that nothing will read again."""
    for df in tables:  # one that is gone already is no error
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def without(docs: DataFrame, ids: DataFrame, name: str, broadcast_ids: int) -> DataFrame:
    """``docs`` (all their columns) less the rows of the given doc_ids, which are written once; sent to the executors if they are few enough."""
    own = fresh(docs.columns, "gone")
    gone = keep(ids.select(F.col("doc_id").alias(own)).distinct(), name)
    return docs.join(F.broadcast(gone) if gone.count() <= broadcast_ids else gone, docs["doc_id"].cast("long") == gone[own], "left_anti")


def release(spark: SparkSession) -> None:
    """Let the context cleaner remove shuffle files of frames that are gone, and give the driver's freed memory back."""
    gc.collect()
    give_back()
    spark.sparkContext._jvm.System.gc()
