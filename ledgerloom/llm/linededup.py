"""Line dedup: lines are exploded to hashes of their normalised form, distinct
documents are counted per hash, lines over the threshold go from all documents
but the last that holds them, and the others are joined again by position.

The key of a line (white space stripped at both ends, A-Z lower-cased) is
hashed to 128 bits by prefix sums over the bytes of a block. Counting is two
aggregations with partial sums before each shuffle, so a line in a third of all
documents arrives as one row per map task. If the repeated keys are at most
``broadcast_keys``, they go to the executors as sorted arrays (24 bytes each);
beyond that they are joined to the lines by hash and gathered by document.

Defined results: a null or empty text is one empty line; repeated rows with one
doc_id count as one document and are treated alike; a null doc_id counts as a
document of its own below all others; a document that loses all its lines has
an empty text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, docs_of, keep, rowed
from .wordhash import _LOWER, BASE, BASE_INV, SPACE, U, mix, powers, row_blocks, text_bytes

_SECOND = mix(_LOWER ^ U(0x5851F42D4C957F2D))
BASE2 = 0xD1342543DE82EF95
BASE2_INV = pow(BASE2, -1, 1 << 64)


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, byte start, byte end, key's code points, two key hashes) of every line of a block."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    row_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    rows = np.arange(len(offsets) - 1)
    starts = np.concatenate([offsets[:-1], breaks + 1])
    row = np.concatenate([rows, row_of_break])
    order = np.lexsort((starts, row))
    starts, row = starts[order], row[order]
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    last = np.empty(len(row), bool)
    last[-1:] = True
    last[:-1] = row[1:] != row[:-1]
    ends[last] = offsets[1:][row[last]]
    solid = np.flatnonzero(~SPACE[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = b > a
    s, e = np.zeros_like(starts), np.zeros_like(starts)
    s[some], e[some] = solid[a[some]], solid[b[some] - 1] + 1
    points = np.zeros(n + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    hashes = []
    for table, base, back in ((_LOWER, BASE, BASE_INV), (_SECOND, BASE2, BASE2_INV)):
        sums = np.zeros(n + 1, U)
        np.cumsum(table[data] * powers(n, base), out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * powers(n + 1, back)[s]).view(np.int64))
    return row, starts, ends, points[e] - points[s], *hashes


def _keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            for first, last in row_blocks(offsets):
                lo, hi = offsets[first], offsets[last]
                row, _, _, points, h1, h2 = lines_of(data[lo:hi], offsets[first : last + 1] - lo)
                long = points >= min_chars
                row, h1, h2 = row[long] + first, h1[long], h2[long]
                order = np.lexsort((h2, h1, row))
                row, h1, h2 = row[order], h1[order], h2[order]
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                own = [c for c in b.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(row[new])) for c in own], pa.array(h1[new]), pa.array(h2[new])], names=[*own, "h1", "h2"])

    return run


def repeated_keys(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(h1, h2, last_doc) of keys in at least ``min_docs`` distinct documents."""
    rows = arrow_map(docs_of(docs), _keys(min_chars), "doc_id long, h1 long, h2 long")
    each = rows.distinct()
    return each.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last_doc")).filter(F.col("n") >= min_docs).drop("n")


def _drop(row_structs: pa.Array, column: pa.Array, min_chars: int, dropped) -> pa.RecordBatch:
    """``dropped(rows, h1, h2)`` tells the lines that go."""
    data, offsets = text_bytes(column)
    texts: list[bytes] = []
    n_lines, n_dropped = np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    for first, last in row_blocks(offsets):
        lo, hi = offsets[first], offsets[last]
        row, s, e, points, h1, h2 = lines_of(data[lo:hi], offsets[first : last + 1] - lo)
        gone = np.zeros(len(row), bool)
        long = np.flatnonzero(points >= min_chars)
        if len(long):
            gone[long] = dropped(row[long] + first, h1[long], h2[long])
        n_lines[first:last] = np.bincount(row, minlength=last - first)
        n_dropped[first:last] = np.bincount(row[gone], minlength=last - first)
        raw = data[lo:hi].tobytes()
        by_row = np.searchsorted(row, np.arange(last - first + 1))
        for r in range(last - first):
            a, b = by_row[r], by_row[r + 1]
            if n_dropped[first + r]:
                texts.append(b"\n".join(raw[s[i] : e[i]] for i in range(a, b) if not gone[i]))
            else:
                texts.append(raw[offsets[first + r] - lo : offsets[first + r + 1] - lo])
    return pa.RecordBatch.from_arrays([row_structs, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n_lines), pa.array(n_dropped)], names=["_row", "text", "n_lines", "n_dropped"])


def _out(rows: DataFrame) -> T.StructType:
    return T.StructType([rows.schema["_row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, broadcast_keys: int = 1_000_000) -> DataFrame:
    """Every document, all its columns (but older ones named n_lines or n_dropped), with ``text`` as what stays of it; then n_lines (before) and n_dropped."""
    base = rowed(docs)
    keys = keep(repeated_keys(docs, min_chars, min_docs), "lines")
    found = (_by_broadcast if keys.count() <= broadcast_keys else _by_join)(base, keys, min_chars)
    return found.select(*[F.col("text") if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def _by_broadcast(base: DataFrame, keys: DataFrame, min_chars: int) -> DataFrame:
    found = keys.toArrow()
    none = np.iinfo(np.int64).min
    h1, h2, top = (found.column(c).fill_null(none).to_numpy() for c in ("h1", "h2", "last_doc"))
    order = np.lexsort((h2, h1))
    held = base.sparkSession.sparkContext.broadcast((h1[order], h2[order], top[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k1, k2, last = held.value
        for b in batches:
            ids = b.column("doc_id").fill_null(none).to_numpy()

            def dropped(row, x1, x2, ids=ids):
                at = np.searchsorted(k1, x1)
                out = np.zeros(len(row), bool)
                live = np.flatnonzero(at < len(k1))
                while len(live):  # equal first hashes stand side by side
                    here = at[live]
                    live = live[k1[here] == x1[live]]
                    hit = k2[at[live]] == x2[live]
                    out[live[hit]] = last[at[live[hit]]] != ids[row[live[hit]]]
                    live = live[~hit]
                    at[live] += 1
                    live = live[at[live] < len(k1)]
                return out

            yield _drop(b.column("_row"), b.column("text"), min_chars, dropped)

    return arrow_map(base, run, _out(base))


def _by_join(base: DataFrame, keys: DataFrame, min_chars: int) -> DataFrame:
    told = base.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(17), "text")})  # rows that share an id, or have none, are gathered by text
    rows = arrow_map(docs_of(told).select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(17), "text").alias("t2"), "text"), _keys(min_chars), "doc_id long, t1 long, t2 long, h1 long, h2 long")
    gone = rows.join(keys, ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    gone = gone.groupBy(F.col("doc_id").alias("_id"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))  # bounded by one text's lines
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2"))
    joined = told.join(gone, same, "left").select("_row", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [{(x["h1"], x["h2"]) for x in v} if v else () for v in b.column("gone").to_pylist()]
            yield _drop(b.column("_row"), b.column("text"), min_chars, lambda row, x1, x2, sets=sets: np.fromiter(((i, j) in sets[r] for r, i, j in zip(row, x1.tolist(), x2.tolist(), strict=True)), bool, len(row)))

    return arrow_map(joined, run, _out(base))
