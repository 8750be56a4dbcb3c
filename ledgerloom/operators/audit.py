"""Hash-chained audit log: extension and verification.

A link is SHA-256 over the previous link and length-prefixed fields. The chain
of a firm is a fold, so a firm's new events pass one task in order;
verification needs no fold: each row is checked against the row before it by a
join, and the recomputed link is a column expression.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("firm_id", "seq", "actor", "action", "entity_id", "detail")
GENESIS = "0" * 64


def canonical_json(value: dict) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def _feed(c: Column) -> Column:
    """Presence byte, four length bytes, bytes: null and empty differ."""
    s = c.cast("string")
    b = F.encode(F.coalesce(s, F.lit("")), "utf-8")
    return F.concat(F.when(s.isNull(), F.lit(b"\x00")).otherwise(F.lit(b"\x01")), F.unhex(F.lpad(F.hex(F.octet_length(b)), 8, "0")), b)


def link(previous: Column) -> Column:
    return F.sha2(F.concat(F.unhex(previous), *[_feed(F.col(f)) for f in FIELDS]), 256)


def extend(events: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """Add prev_hash and hash to events (FIELDS) of each firm, in order of seq, after its pinned head if ``heads`` has one.

    A link needs the one before it, so a firm's events pass one task in order,
    which holds one link however many there are.
    """
    own = events.select(*FIELDS)
    schema = own.schema.add("prev_hash", "string").add("hash", "string")
    if heads is not None:
        own = own.join(heads.select("firm_id", F.col("head_hash").alias("_head")), "firm_id", "left")
    else:
        own = own.withColumn("_head", F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firm, link_now = None, b""
        for b in batches:
            before, after = [], []
            for *values, head in zip(*[b.column(c).to_pylist() for c in (*FIELDS, "_head")], strict=True):
                if firm is None or values[0] != firm[0]:
                    firm, link_now = (values[0],), bytes.fromhex(head or GENESIS)
                before.append(link_now.hex())
                raw = [None if v is None else str(v).encode() for v in values]
                link_now = hashlib.sha256(link_now + b"".join(b"\x00" + bytes(4) if v is None else b"\x01" + len(v).to_bytes(4, "big") + v for v in raw)).digest()
                after.append(link_now.hex())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in FIELDS], pa.array(before, pa.string()), pa.array(after, pa.string())], names=[*FIELDS, "prev_hash", "hash"])

    return own.repartition("firm_id").sortWithinPartitions("firm_id", "seq").mapInArrow(run, schema)


def verify(chain: DataFrame, heads: DataFrame) -> DataFrame:
    """(firm_id, seq, problem): EDITED, GAP (the row before is not there, or a seq is there twice), BROKEN_LINK, and TRUNCATED against the pinned heads (firm_id, head_seq, head_hash).

    A row meets the one before it by a join on firm and seq, so a firm's chain is
    checked by as many tasks as there are.
    """
    there = chain.groupBy("firm_id", "seq").agg(F.count(F.lit(1)).alias("_times"), F.min("hash").alias("_low"), F.max("hash").alias("_high"))
    before = there.select("firm_id", (F.col("seq") + 1).alias("seq"), "_low", "_high")
    c = chain.join(before, ["firm_id", "seq"], "left")
    first = F.col("seq") == 1
    linked = F.when(first, F.col("prev_hash") == GENESIS).otherwise(F.col("prev_hash").isin(F.col("_low"), F.col("_high")))
    problem = F.when(F.col("hash") != link(F.col("prev_hash")), "EDITED").when(~first & F.col("_low").isNull(), "GAP").when(~linked, "BROKEN_LINK")
    rows = c.withColumn("problem", problem).filter("problem is not null").select("firm_id", "seq", "problem")
    twice = there.filter("_times > 1").select("firm_id", "seq", F.lit("GAP").alias("problem"))
    tails = pin_heads(chain).select("firm_id", F.col("head_seq").alias("_seq"), F.col("head_hash").alias("_hash"))
    cut = heads.join(tails, "firm_id", "left").filter(F.col("_seq").isNull() | (F.col("_seq") < F.col("head_seq")) | ((F.col("_seq") == F.col("head_seq")) & (F.col("_hash") != F.col("head_hash"))))
    return rows.unionByName(twice).unionByName(cut.select("firm_id", F.col("head_seq").alias("seq"), F.lit("TRUNCATED").alias("problem")))


def pin_heads(chain: DataFrame) -> DataFrame:
    return chain.groupBy("firm_id").agg(F.max(F.struct("seq", "hash")).alias("t")).select("firm_id", F.col("t.seq").alias("head_seq"), F.col("t.hash").alias("head_hash"))
