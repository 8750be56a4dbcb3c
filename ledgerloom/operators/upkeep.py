"""Keeping stored state current by what has changed: imports, decisions and dashboard views in a ``Store``.

Every table is cut by firm and by a bucket of the client, so a change costs the
parts that it touches. Which parts those are is told by small tables: digests
of the snapshot, dirty units, deltas of filings' states.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import row_bits
from ..rules import RuleSet
from ..session import drop_scratch, scratch, writing
from ..store import Part, Store, bucket
from . import determine as D
from . import merge as M
from . import views as V
from .runs import run_header

BY = ["firm_id", "bucket"]
UNIT = ["firm_id", "bucket", "client_id", "source_system", "tax_year"]
BUCKETS = 16


def cut(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", bucket("client_id", buckets))


def parts_of(rows: DataFrame) -> list[Part]:
    """The parts that rows belong to: at most as many as the store has or will have."""
    return [(str(r.firm_id), str(r.bucket)) for r in rows.select(*BY).distinct().collect()]


def in_parts(rows: DataFrame, parts: list[Part]) -> DataFrame:
    """``rows`` of the given parts."""
    own = rows.sparkSession.createDataFrame([(f, int(b)) for f, b in parts], "_firm string, _bucket int")
    return rows.join(F.broadcast(own), (F.col("firm_id").cast("string") == F.col("_firm")) & (F.col("bucket") == F.col("_bucket")), "left_semi")


# -- imports --------------------------------------------------------------------


def digests(rows: DataFrame) -> DataFrame:
    """Of the live rows of each firm, bucket, client, system and year: their number, cents, and the XOR of both halves of their hashes' first 128 bits. Two sets of rows with one digest are the same set."""
    live = rows.filter(~F.col("deleted")) if "deleted" in rows.columns else rows
    return live.groupBy(*UNIT).agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("cents"), F.bit_xor(row_bits(F.col("row_hash"))).alias("x"), F.bit_xor(row_bits(F.substring("row_hash", 17, 16))).alias("y"))


Scope = Callable[[str], Column]


def declared(clients: list, systems: list[str], years: list[int]) -> Scope:
    """What a source declares to be complete, as a condition on columns whose year has a prefix."""
    return lambda prefix: F.col("client_id").isin(*clients) & F.col("source_system").isin(*systems) & F.col(f"{prefix}tax_year").isin(*years)


def differing(stored: DataFrame, new: DataFrame, scope: Scope) -> DataFrame:
    """(firm_id, bucket) of the parts in which a source differs from the snapshot, told by digests alone. Outside of ``scope`` absence says nothing."""
    what = ["n", "cents", "x", "y"]
    s = stored.select(*UNIT, F.struct(*what).alias("s"))
    n = new.select(*UNIT, F.struct(*what).alias("n"))
    return s.join(n, UNIT, "full_outer").filter(~F.col("s").eqNullSafe(F.col("n")) & (F.col("n").isNotNull() | F.coalesce(scope(""), F.lit(False)))).select(*BY).distinct()


@dataclass
class Applied:
    parts: list[Part]  # that were read and rewritten
    counts: dict[str, int]  # changes by kind in these parts


def apply_source(store: Store, source: DataFrame, scope: Scope, run_id: int, buckets: int = BUCKETS, salts: int = 4) -> Applied:
    """Merge a source into the stored snapshot and publish snapshot, digests and dirty units in one commit.

    ``buckets`` is how many parts a firm has, ``salts`` how many tasks write a part
    that is large. The source is read once for its digests, and once more only in
    the parts that differ; only these parts of the snapshot are read and written.
    An unchanged source thus touches no file of the snapshot and commits nothing.
    """
    new = cut(source, buckets)
    if not store.has("snapshot"):
        return _first(store, new, run_id, salts)
    parts = parts_of(differing(store.read("digests"), digests(new), scope))
    if not parts:
        return Applied([], {})
    mine, old = in_parts(new, parts), store.read("snapshot", parts)
    where = scratch(store.spark, "changes")
    values = [c for c in source.columns if c not in M.KEY]
    with writing(store.spark):  # one copy of each row: the one that stays, what happened to it and its old year
        M.merged(M.diff(old.drop("bucket"), mine.drop("bucket"), scope("o_")), values, ("change", "o_tax_year")).write.parquet(where)
    try:
        changes = store.spark.read.parquet(where)
        snapshot = cut(changes.drop("change", "o_tax_year"), buckets)
        there = ~F.col("change").isin("tombstoned", "untouched")
        dirty = M.dirty_units(changes.withColumn("n_tax_year", F.when(there, F.col("tax_year")))).withColumn("marked_at", F.lit(run_id))
        with store.transaction() as t:
            t.overwrite("snapshot", snapshot, parts)
            t.overwrite("digests", digests(snapshot), parts)
            t.append("dirty", dirty)
        return Applied(parts, {r.change: r.n for r in M.change_counts(changes).collect()})
    finally:
        drop_scratch(store.spark, where)


def _first(store: Store, new: DataFrame, run_id: int, salts: int) -> Applied:
    """The first source of a store: all of it is inserted, so it is read once, as the snapshot is written; digests, dirty units and counts come from what was written."""
    values = [c for c in new.columns if c not in M.KEY and c != "bucket"]
    with store.transaction() as t:
        t.replace("snapshot", new.select(*M.KEY, *values, F.lit(False).alias("deleted"), "bucket"), BY, salts)
        parts = t.parts("snapshot")
        if not parts:
            t.forget()
            return Applied([], {})
        t.replace("digests", digests(t.written("snapshot")), BY)
        units = t.written("digests")  # a row a client, system and year
        t.append("dirty", units.filter("tax_year is not null").select("firm_id", "client_id", "tax_year").distinct().withColumn("marked_at", F.lit(run_id)))
        return Applied(parts, {"inserted": units.agg(F.sum("n")).first()[0]})


def import_judged(store: Store, judged: DataFrame, firm_id: int, key: bytes, scope: Scope, run_id: int, most_rejected: float = 0.05, buckets: int = BUCKETS) -> Applied:
    """One import of judged records into the store, in two commits.

    The first publishes the run's rejections and that it is running. Then comes
    the guard: too many rejections end the run, as does any failure of the merge,
    and leave the snapshot what it was, the rejections readable and the run
    FAILED. The second commit is that of ``apply_source``.
    """
    from ..sources import export

    with store.transaction() as t:
        t.append("rejections", export.rejections(judged, run_id))
        t.append("runs", run_header(store.spark, run_id, "RUNNING", {}, {}))
    counters: dict[str, int] = {}
    try:
        counters["rows_read"], counters["rows_rejected"] = export.guard(judged, most_rejected)
        rows = M.keep_last(export.normalize(judged, firm_id, key), M.KEY, [F.col("file_name"), F.col("line_no")])
        applied = apply_source(store, rows.select(*export.SNAPSHOT), scope, run_id, buckets)
    except BaseException:
        with store.transaction() as t:
            t.append("runs", run_header(store.spark, run_id, "FAILED", counters, {}))
        raise
    with store.transaction() as t:
        t.append("runs", run_header(store.spark, run_id, "COMPLETED", counters | applied.counts, {}))
    return applied


def import_directory(store: Store, directory: str, firm_id: int, key: bytes, run_id: int, most_rejected: float = 0.05, buckets: int = BUCKETS) -> Applied:
    """Read an export directory, judge its records once and import them; the declared clients, systems and years are the scope."""
    from functools import reduce

    from ..sources import export

    m = export.read_manifest(store.spark, directory)
    raw = reduce(DataFrame.unionByName, [export.read_payments(store.spark, f"{directory}/{name}", system) for name, system in m.files])
    where = scratch(store.spark, "judged")
    with writing(store.spark):
        export.judge(raw, export.read_clients(store.spark, directory)).write.parquet(where)
    try:
        scope = declared(list(m.client_refs), sorted({s for _, s in m.files}), list(m.covered_years))
        return import_judged(store, store.spark.read.parquet(where), firm_id, key, scope, run_id, most_rejected, buckets)
    finally:
        drop_scratch(store.spark, where)


# -- decisions ------------------------------------------------------------------


def refresh_decisions(store: Store, aliases: DataFrame, rules: RuleSet, buckets: int = BUCKETS) -> list[Part]:
    """Decide the clients of dirty units anew and write them back: the parts of the store that hold one are read and replaced, all others keep their files. Returns these parts; with nothing dirty nothing is read but the dirty units.

    A decision also counts what lies outside its year, so a unit of any year makes
    a client dirty. Each rule year has a watermark, the last run whose marks it has
    worked off; marks that all years are through with go. Decisions, watermarks and
    dirty units are one commit.
    """
    version, year = store.version(), rules.tax_year
    marks = {r.tax_year: r.marked_at for r in store.read("watermarks", version=version).collect()} if store.has("watermarks") else {}  # a row a rule year
    units = store.read("dirty", version=version)
    dirty = units.filter(F.col("marked_at") > marks.get(year, -1)).select("firm_id", "client_id").distinct().withColumn("tax_year", F.lit(year))
    full = not store.has("decisions")
    parts = list(store.parts("snapshot", version)) if full else parts_of(cut(dirty, buckets))
    if not parts:
        return []
    snapshot = store.read("snapshot", parts, version)
    decided = D.determine(snapshot, aliases, rules)[1] if full else D.incremental(snapshot, aliases, rules, dirty, store.read("decisions", parts, version).drop("bucket"))
    marks[year] = units.agg(F.max("marked_at")).first()[0]
    with store.transaction() as t:
        if full:
            t.replace("decisions", cut(decided, buckets), BY)
        else:
            t.overwrite("decisions", cut(decided, buckets), parts)
        if marks[year] is not None:
            t.replace("watermarks", store.spark.createDataFrame(sorted(marks.items()), "tax_year int, marked_at int"))
            t.replace("dirty", units.filter(F.col("marked_at") > min(marks.values())))
    return parts


# -- dashboard views --------------------------------------------------------------


def status_moves(old: DataFrame, new: DataFrame) -> DataFrame:
    """firm_id, client_id, tax_year, old_state, new_state, old_cents, new_cents of the filings that differ between two states of them; null where there was or is none."""
    key = ["firm_id", "client_id", "tax_year", "filing_id"]
    side = lambda df, p: df.select(*key, F.col("state").alias(f"{p}_state"), F.col("amount_cents").alias(f"{p}_cents"))
    both = side(old, "old").join(side(new, "new"), key, "full_outer")
    moved = ~(F.col("old_state").eqNullSafe(F.col("new_state")) & F.col("old_cents").eqNullSafe(F.col("new_cents")))
    return both.filter(moved).drop("filing_id")


def status_deltas(moves: DataFrame) -> DataFrame:
    """What moves add to and take from the counts that ``views.status_counts`` keeps."""
    side = lambda p, sign: moves.filter(f"{p}_state is not null").select("firm_id", "client_id", "tax_year", F.col(f"{p}_state").alias("state"), F.col(f"{p}_cents").alias("amount_cents"), F.lit(sign).alias("_sign"))
    return V.status_counts(side("old", -1).unionByName(side("new", 1)), F.col("_sign"))


def attention_deltas(changes: DataFrame) -> DataFrame:
    """firm_id, client_id, severity, n from changes of open items (firm_id, client_id, severity, ``sign`` 1: opened, -1: resolved)."""
    return changes.groupBy("firm_id", "client_id", "severity").agg(F.sum("sign").cast("long").alias("n"))


def move_counts(store: Store, name: str, deltas: DataFrame, key: list[str], buckets: int = BUCKETS) -> list[Part]:
    """Add deltas to a stored table of counts, in the parts that they touch; a row whose counts are all zero goes."""
    deltas = cut(deltas, buckets)
    if not store.has(name):
        with store.transaction() as t:
            t.replace(name, deltas, BY)
        return list(store.parts(name))
    where = scratch(store.spark, "deltas")
    deltas.write.parquet(where)
    try:
        deltas = store.spark.read.parquet(where)
        parts = parts_of(deltas)
        if parts:
            counts = [c for c in deltas.columns if c not in [*key, "bucket"]]
            both = store.read(name, parts).unionByName(deltas).groupBy(*key, "bucket").agg(*[F.sum(c).cast("long").alias(c) for c in counts])
            with store.transaction() as t:
                t.overwrite(name, both.filter(" or ".join(f"{c} <> 0" for c in counts)), parts)
        return parts
    finally:
        drop_scratch(store.spark, where)


def refresh_exceptions(store: Store, attention: DataFrame, raised: DataFrame, filings: DataFrame, clients: DataFrame | None = None, buckets: int = BUCKETS) -> list[Part]:
    """Keep the rows of the exception view that belong to clients; ``clients`` (firm_id, client_id) are those whose attention or decisions changed, all if it is None. Rejected rows belong to runs and are no part of it."""
    build = lambda a, r, f: cut(V.open_exceptions(a, r, f), buckets)
    if clients is None or not store.has("exceptions"):
        with store.transaction() as t:
            t.replace("exceptions", build(attention, raised, filings), BY)
        return list(store.parts("exceptions"))
    parts = parts_of(cut(clients, buckets))
    if parts:
        own = lambda df: in_parts(cut(df, buckets), parts).drop("bucket")
        with store.transaction() as t:
            t.overwrite("exceptions", build(own(attention), own(raised), own(filings)), parts)
    return parts
