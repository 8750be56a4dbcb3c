"""Snapshot merge: dedupe, idempotent upsert, scoped tombstones, dirty units, history, checksums.

A snapshot is immutable; a merge is one full-outer join of the old snapshot and
the source on the natural key, from which the new snapshot, the change counts
and the dirty units all follow. Nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import row_bits

KEY = ["firm_id", "client_id", "source_system", "source_txn_id"]


def keep_last(staged: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last physical copy of each key; ``order`` must be total. A maximum, so copies meet before the shuffle."""
    best = staged.groupBy(*key).agg(F.max_by(F.struct(*staged.columns), F.struct(*order)).alias("_best"))
    return best.select("_best.*")


def duplicate_ordinals(rows: DataFrame, natural: list[str], order: list[Column]) -> DataFrame:
    """``ordinal``: 1, 2, ... of equal natural tuples in file order."""
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(*natural).orderBy(*order)))


def diff(old: DataFrame, new: DataFrame, scope: Column | None = None) -> DataFrame:
    """old ⟗ new on the key with ``change``: inserted, updated, resurrected, unchanged, tombstoned (in ``scope``, live and absent from the source) or untouched.

    Both sides hold KEY, row_hash, client attributes; old also ``deleted``. An old row is named by o_*, a new one by n_*.
    """
    o = old.select(*[F.col(k) for k in KEY], *[F.col(c).alias(f"o_{c}") for c in old.columns if c not in KEY])
    n = new.select(*[F.col(k) for k in KEY], *[F.col(c).alias(f"n_{c}") for c in new.columns if c not in KEY])
    both = o.join(n, KEY, "full_outer")
    absent = F.col("n_row_hash").isNull()
    change = (
        F.when(F.col("o_row_hash").isNull(), "inserted")
        .when(absent & ~F.col("o_deleted") & (F.lit(True) if scope is None else F.coalesce(scope, F.lit(False))), "tombstoned")
        .when(absent, "untouched")
        .when(F.col("o_deleted"), "resurrected")
        .when(~F.col("o_row_hash").eqNullSafe(F.col("n_row_hash")), "updated")
        .otherwise("unchanged")
    )
    return both.withColumn("change", change)


def merged(changes: DataFrame, columns: list[str], also: tuple[str, ...] = ()) -> DataFrame:
    """The new snapshot: the source's values where it has the row, the old ones elsewhere; ``deleted`` set by the change. ``also`` names columns of ``changes`` that come along."""
    value = [F.when(F.col("n_row_hash").isNotNull(), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in columns if c not in KEY]
    gone = F.when(F.col("change") == "tombstoned", True).when(F.col("change") == "untouched", F.col("o_deleted")).otherwise(False)
    return changes.select(*KEY, *value, gone.alias("deleted"), *also)


def dirty_units(changes: DataFrame, year: str = "tax_year") -> DataFrame:
    """(firm, client, year) touched by a change: the old year, the new one, or both."""
    touched = changes.filter(~F.col("change").isin("unchanged", "untouched"))
    both = F.explode(F.array(F.col(f"o_{year}"), F.col(f"n_{year}")))
    return touched.select("firm_id", "client_id", both.alias("tax_year")).filter("tax_year is not null").distinct()


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n"))


def checksum(snapshot: DataFrame) -> DataFrame:
    """Order-free checksum of the live rows of each firm: XOR of the hashes' leading 64 bits, and counts."""
    live = ~F.col("deleted")
    bits = row_bits(F.col("row_hash"))
    return snapshot.groupBy("firm_id").agg(
        F.coalesce(F.bit_xor(F.when(live, bits)), F.lit(0)).alias("book_xor"), F.count(F.when(live, 1)).alias("n_live"),
        F.count(F.when(F.col("deleted"), 1)).alias("n_deleted"), F.count_distinct(F.when(live, F.col("client_id"))).alias("n_clients"),
        F.coalesce(F.sum(F.when(live, F.col("amount_cents"))), F.lit(0)).alias("live_cents"),
    )


CHECKS = ("book_xor", "live_cents", "n_clients", "n_deleted", "n_live", "no_inserts_or_updates", "no_tombstones")


def verify_idempotent(changes: DataFrame) -> DataFrame:
    """Seven checks (check, ok) that a repeated import changed nothing, from its changes alone: old and new snapshot stand side by side in them, so the checksums before and after are one aggregation of one join."""
    before = F.col("o_row_hash").isNotNull() & ~F.coalesce("o_deleted", F.lit(False))
    there = F.col("n_row_hash").isNotNull()
    gone = F.when(F.col("change") == "tombstoned", True).when(F.col("change") == "untouched", F.col("o_deleted")).otherwise(False)
    sums = []
    for side, live, dead, old in (("b", before, F.col("o_row_hash").isNotNull() & F.col("o_deleted"), F.lit(True)), ("a", ~gone, gone, ~there)):
        value = lambda c, old=old: F.when(old, F.col(f"o_{c}")).otherwise(F.col(f"n_{c}"))
        sums += [
            F.coalesce(F.bit_xor(F.when(live, row_bits(value("row_hash")))), F.lit(0)).alias(f"{side}_book_xor"), F.coalesce(F.sum(F.when(live, value("amount_cents"))), F.lit(0)).alias(f"{side}_live_cents"),
            F.count_distinct(F.when(live, F.col("client_id"))).alias(f"{side}_n_clients"), F.count(F.when(dead, 1)).alias(f"{side}_n_deleted"), F.count(F.when(live, 1)).alias(f"{side}_n_live"),
        ]
    of = lambda *kinds: F.count(F.when(F.col("change").isin(*kinds), 1)) == 0
    firms = changes.groupBy("firm_id").agg(*sums, of("inserted", "updated", "resurrected").alias("no_inserts_or_updates"), of("tombstoned").alias("no_tombstones"))
    ok = [F.coalesce(F.bool_and(F.col(c) if c.startswith("no_") else F.col(f"b_{c}") == F.col(f"a_{c}")), F.lit(True)).alias(c) for c in CHECKS]
    return firms.agg(*ok).select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("ok")) for c in CHECKS])).alias("x")).select("x.*")


def upsert_coalesce(old: DataFrame, new: DataFrame, key: list[str], sticky: list[str], latest: list[str]) -> DataFrame:
    """Upsert in which ``sticky`` columns keep the old value when the new one is null, and ``latest`` ones take the new row's."""
    o = old.select(*key, *[F.col(c).alias(f"o_{c}") for c in sticky + latest], F.lit(True).alias("o_there"))
    n = new.select(*key, *[F.col(c).alias(f"n_{c}") for c in sticky + latest], F.lit(True).alias("n_there"))
    both = o.join(n, key, "full_outer")
    return both.select(*key, *[F.coalesce(f"n_{c}", f"o_{c}").alias(c) for c in sticky], *[F.when(F.col("n_there"), F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in latest])


def vendors(rows: DataFrame) -> DataFrame:
    """One vendor per (firm, client, identity): the number or else the name; prefers rows with a number, then the latest payment."""
    key = F.coalesce(F.concat(F.lit("TIN:"), "tin_bidx"), F.concat(F.lit("NAME:"), "name_norm"))
    kept = ["name_raw", "tin_last4", "tin_status", "payment_date"]
    latest_first = F.coalesce(-F.unix_date("payment_date"), F.lit((1 << 31) - 1))
    best = F.min_by(F.struct(*kept), F.struct(F.col("tin_bidx").isNull(), latest_first, F.col("line_id"))).alias("_best")
    return rows.withColumn("natural_key", key).groupBy("firm_id", "client_id", "natural_key").agg(best).select("firm_id", "client_id", "natural_key", "_best.*")


def history(current: DataFrame, decided: DataFrame, scope: DataFrame, key: list[str], values: list[str], run: int, only_changes: bool = True) -> DataFrame:
    """Type-2 history: versions (valid_from, valid_to; null is open) after a run over ``scope`` (firm, client).

    Open versions of the scope close and new ones open; with ``only_changes`` a version whose values stay the same stays open, so a repeated run adds no rows.
    """
    own = ["firm_id", "client_id"]
    open_, closed = current.filter("valid_to is null"), current.filter("valid_to is not null")
    outside = open_.join(scope, own, "left_anti")
    inside = open_.join(scope, own, "left_semi").withColumn("_v", F.sha2(F.to_json(F.struct(*values)), 256))
    fresh = decided.join(scope, own, "left_semi").withColumn("_v", F.sha2(F.to_json(F.struct(*values)), 256))
    same = inside.join(fresh.select(*key, "_v"), [*key, "_v"], "left_semi") if only_changes else inside.limit(0)
    ended = inside.join(same.select(*key, "_v"), [*key, "_v"], "left_anti").withColumn("valid_to", F.lit(run))
    begun = fresh.join(same.select(*key, "_v"), [*key, "_v"], "left_anti").withColumns({"valid_from": F.lit(run), "valid_to": F.lit(None).cast("int")})
    cols = [*key, *values, "valid_from", "valid_to"]
    out = closed.select(*cols)
    for part in (outside, same, ended, begun):
        out = out.unionByName(part.select(*cols))
    return out


def insert_if_absent(open_items: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``new`` rows whose key has no open item, after the open items."""
    return open_items.unionByName(new.join(open_items.select(*key), key, "left_anti").dropDuplicates(key))
