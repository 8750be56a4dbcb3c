"""Removal of spans from texts: what the operators on repeated strings share besides their search.

A text is known by 128 bits of hash, so a row keeps its key when it is read
again, and copies of one text are one key. A run is a stretch of windows that
start one after another in a text: ``pack`` holds its first start, the number of
further windows and the distance from the first start to the run's pivot.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrow_map, keep, release, small_batches
from .wordhash import U, text_bytes

NO_ID = -(1 << 63)
CHUNK = 1 << 19
_FIELD = U(0xFFF)


def pack(s: np.ndarray, more: np.ndarray, dist: np.ndarray) -> np.ndarray:
    """start (40 bits), further windows (12), distance of the pivot (12) in one long."""
    return ((s.astype(U) << U(24)) | (more.astype(U) << U(12)) | dist.astype(U)).view(np.int64)


def unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = np.ascontiguousarray(p).view(U)
    return tuple(x.astype(np.int64) for x in (p >> U(24), (p >> U(12)) & _FIELD, p & _FIELD))


def start_of(p: str = "p") -> Column:
    return F.shiftrightunsigned(p, 24)


def more_of(p: str = "p") -> Column:
    return F.shiftrightunsigned(p, 12).bitwiseAND(F.lit(0xFFF))


def based(docs: DataFrame) -> DataFrame:
    """(_row, id, h1, h2, text): id is the doc_id (null below all), h1 and h2 know the text."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"])
    return docs.select(rest.alias("_row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(17), text).alias("h2"), text.alias("text"))


def modest(small: DataFrame, rows: int) -> DataFrame:
    """``small``, sent to the executors if it has at most ``rows`` rows."""
    return F.broadcast(small) if small.count() <= rows else small


def join_all(many: DataFrame, classes: DataFrame, key: list[str], broadcast_rows: int, hot: int = 20_000, number: str = "n") -> DataFrame:
    """``many`` inner-joined with ``classes`` (one row a key, with the ``number`` of its rows): keys of ``hot`` rows and more are sent to the executors if they are few enough, so that no task gets all of such a key."""
    crowded = classes.filter(F.col(number) >= hot)
    if not 0 < crowded.count() <= broadcast_rows:
        return many.join(classes, key)
    return many.join(F.broadcast(crowded), key).unionByName(many.join(F.broadcast(crowded.select(*key)), key, "left_anti").join(classes.filter(F.col(number) < hot), key))


def merged(a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint maximal stretches (touching ones joined) of a row's spans."""
    if not len(a):
        return a, z
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order])
    new = np.ones(len(a), bool)
    new[1:] = a[1:] > z[:-1]
    return a[new], z[np.append(np.flatnonzero(new)[1:], len(a)) - 1]


def gathered(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """(key, spans) of frames (key, a, z): a text's spans, each once, in one array, written."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return keep(both.select(*key, "a", "z").distinct().groupBy(*key).agg(F.collect_list(F.struct("a", "z")).alias("spans")), "spans")


def stretches(covered: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the elements that the marked windows of each row cover."""
    edge = np.diff(np.pad(covered, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, a = np.nonzero(edge == 1)
    _, z = np.nonzero(edge == -1)
    return row, a, z - 1 + width


def neighbours(rows: list[bytes], group: np.ndarray, item: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted order by group and content, elements shared with the one before; -1 at a group's first): a suffix array with its common-prefix lengths."""
    order = np.array(sorted(range(len(rows)), key=lambda i: (group[i], rows[i])))
    longest = max(map(len, rows)) // item
    kind = np.dtype(">u8") if item == 8 else np.dtype(np.uint8)
    table = np.frombuffer(b"".join(x.ljust(longest * item, b"\0") for x in rows), kind).reshape(len(rows), longest)[order] if longest else np.zeros((len(rows), 0), np.uint8)
    shared = np.full(len(rows), -1, np.int64)
    if len(rows) > 1:
        differ = table[1:] != table[:-1]
        shared[1:] = np.where(differ.any(1), differ.argmax(1), longest) if longest else 0
        shared[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, shared


def by_group(solve: Callable[[pa.Table], pa.RecordBatch], key: str, rows_at_once: int):
    """An Arrow function over rows sorted by ``key`` that calls ``solve`` with whole groups, about ``rows_at_once`` rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            for at in range(0, b.num_rows, rows_at_once):
                held.append(b.slice(at, rows_at_once))
                count += held[-1].num_rows
                if count >= rows_at_once:
                    table = pa.Table.from_batches(held)
                    keys = table.column(key).to_numpy()
                    cut = int(np.searchsorted(keys, keys[-1], side="left"))
                    if cut:
                        yield solve(table.slice(0, cut))
                        held = table.slice(cut).to_batches()
                        count = len(keys) - cut
        if count:
            yield solve(pa.Table.from_batches(held))

    return run


def remove(docs: DataFrame, search: Callable[[DataFrame], DataFrame], key: list[str], cut: Callable, fields: str, broadcast_rows: int) -> DataFrame:
    """Apply ``cut(text, starts, ends) -> tuple`` to every document; ``fields`` names what it returns. All other columns pass on in ``_row``.

    ``search`` finds (key, spans) of the texts that lose something. The others
    never meet that join: they are told by their hashes, sent to the executors if
    they are few enough.
    """
    base = based(docs)
    spans = search(base)
    names = [f.strip().split(" ")[0] for f in fields.split(",")]
    schema = T.StructType([base.schema["_row"], *T._parse_datatype_string(fields).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans_col = b.column("spans")
            bounds, flat = np.asarray(spans_col.offsets), spans_col.values
            a, z = np.asarray(flat.field("a")), np.asarray(flat.field("z"))
            data, offsets = text_bytes(b.column("text"))
            raw = memoryview(data)
            out = []
            for i in range(b.num_rows):
                lo, hi = bounds[i], bounds[i + 1]
                out.append(cut(bytes(raw[offsets[i] : offsets[i + 1]]), *merged(a[lo:hi], z[lo:hi])))
            columns = zip(*out, strict=True) if out else [()] * len(names)
            arrays = [pa.array(x, to_arrow_type(f.dataType)) for x, f in zip(columns, schema.fields[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("_row"), *arrays], names=["_row", *names])

    none = F.array().cast("array<struct<a:bigint,z:bigint>>")
    owners = keep(spans.select("h1").distinct(), "owners")
    if owners.count() <= broadcast_rows:
        with_spans = base.join(F.broadcast(owners), "h1", "left_semi").join(spans, key, "left")
        without = base.join(F.broadcast(owners), "h1", "left_anti").withColumn("spans", none)
        both = with_spans.select("_row", "text", F.coalesce("spans", none).alias("spans")).unionByName(without.select("_row", "text", "spans"))
    else:
        both = base.join(spans, key, "left").select("_row", "text", F.coalesce("spans", none).alias("spans"))
    release(docs.sparkSession)
    return arrow_map(both, run, schema)

