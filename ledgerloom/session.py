"""Tenancy: the only way to a table is through a firm, and a missing firm is an error, not an empty result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables without a firm column that every firm may read.
SHARED = frozenset({"firm", "reason_code"})


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir. A local session that names none (tests) gets a temporary one; on a cluster that is an error, as no other machine would see it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``scratch`` named."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


#: What holds while a table is written that others are made from. Its shuffle files go once it stands, not when the driver happens to collect its garbage;
#: and a generated method that the JVM would leave to its interpreter (of over 8,000 bytes: rows of many expressions) is cut into smaller ones.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.codegen.hugeMethodLimit": "8000"}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """``WRITING`` for the writes of its block, in this session."""
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class MissingFirm(RuntimeError):
    pass


@dataclass
class FirmSession:
    spark: SparkSession
    tables: dict[str, Callable[[], DataFrame]]
    firm_id: int | None = None

    def table(self, name: str) -> DataFrame:
        df = self.tables[name]()
        if name in SHARED:
            return df
        if self.firm_id is None:
            raise MissingFirm(f"{name}: no firm is set")
        return df.filter(F.col("firm_id") == self.firm_id)

    def checked_write(self, df: DataFrame) -> DataFrame:
        """``df`` if all its rows are the firm's own."""
        if self.firm_id is None:
            raise MissingFirm("no firm is set")
        if not df.filter(~F.col("firm_id").eqNullSafe(F.lit(self.firm_id))).isEmpty():
            raise MissingFirm("rows of another firm")
        return df


    def proved(self, df: DataFrame) -> DataFrame:
        """``df`` if its plan proves that it reads no row of another firm."""
        if self.firm_id is None:
            raise MissingFirm("no firm is set")
        loose = unproved(df, self.firm_id, SHARED)
        if loose:
            raise MissingFirm(f"read without a filter on the firm: {', '.join(loose)}")
        return df


def unproved(df: DataFrame, firm_id: int, shared: frozenset[str] = SHARED) -> list[str]:
    """The sources that a frame reads without a filter to the firm, by its optimized plan; empty is a proof.

    Catalyst pushes a filter on the firm down to every source it holds for, through
    projections, groupings by the firm and joins on it. So it is enough to ask of
    each source that a condition ``firm_id = <the firm>`` stands right above it,
    with only projections and filters between. A source is known by the last part
    of its path without suffix, or by its table name; one in ``shared``, and one
    without a row of its own (a range, literals), needs no filter.
    """
    loose: list[str] = []

    def equated(e) -> set[int]:
        """Ids of attributes that a condition holds equal to the firm."""
        kind = e.getClass().getSimpleName()
        if kind == "And":
            return equated(e.left()) | equated(e.right())
        if kind in ("EqualTo", "EqualNullSafe"):
            for a, b in ((e.left(), e.right()), (e.right(), e.left())):
                while a.getClass().getSimpleName() == "Cast":  # of the column to the literal's type
                    a = a.child()
                if a.getClass().getSimpleName() == "AttributeReference" and b.getClass().getSimpleName() == "Literal" and str(b.value()) == str(firm_id):
                    return {a.exprId().id()}
        return set()

    def sequence(s) -> list:
        return [s.apply(i) for i in range(s.size())]

    def walk(node, guards: set[int]) -> None:
        kind, below = node.nodeName(), sequence(node.children())
        for sub in sequence(node.subqueries()):
            walk(sub, set())
        if not below:
            firm = [a.exprId().id() for a in sequence(node.output()) if a.name() == "firm_id"]
            if not any(i in guards for i in firm):
                name = _source(node)
                if name is not None and name not in shared:
                    loose.append(name)
            return
        if kind == "Filter":
            guards = guards | equated(node.condition())
        elif kind == "Project":
            for a in sequence(node.projectList()):
                if a.getClass().getSimpleName() == "Alias" and a.exprId().id() in guards and a.child().getClass().getSimpleName() == "AttributeReference":
                    guards = guards | {a.child().exprId().id()}
        elif kind not in ("SubqueryAlias", "View", "RebalancePartitions", "Repartition", "RepartitionByExpression"):
            guards = set()
        for child in below:
            walk(child, guards)

    walk(df._jdf.queryExecution().optimizedPlan(), set())
    return sorted(loose)


def _source(leaf) -> str | None:
    """What a leaf of a plan reads, None if it is no stored source."""
    kind = leaf.getClass().getSimpleName()
    if kind in ("Range", "OneRowRelation", "LocalRelation"):
        return None
    if kind == "LogicalRelation":
        table = leaf.catalogTable()
        if table.isDefined():
            return table.get().identifier().table()
        paths = getattr(leaf.relation(), "location", None)
        roots = paths().rootPaths() if paths is not None else None
        if roots is not None and roots.size():
            return roots.apply(0).getName().split(".")[0]
    return kind


def catalog_facts(spark: SparkSession, database: str | None = None, shared: frozenset[str] = SHARED) -> list[tuple[str, int, bool, bool]]:
    """(table, columns, has a firm column, is shared) of every table and view that is registered in a database and in the session: the facts of the start-up check, from the catalog itself."""
    out = []
    for t in spark.catalog.listTables(database):
        columns = [c.name for c in spark.catalog.listColumns(t.name if t.isTemporary else f"{t.namespace[0]}.{t.name}")]
        out.append((t.name, len(columns), "firm_id" in columns, t.name in shared))
    return sorted(out)


def start_up_check(spark: SparkSession, database: str | None = None, shared: frozenset[str] = SHARED) -> None:
    """Raises if a registered table neither has a firm column nor is shared."""
    loose = [name for name, _, guarded, allowed in catalog_facts(spark, database, shared) if not (guarded or allowed)]
    if loose:
        raise MissingFirm(f"tables without a firm: {', '.join(loose)}")


def unguarded(tables: dict[str, Callable[[], DataFrame]]) -> list[str]:
    """Registered tables that neither have a firm column nor are shared: must be empty at start."""
    return sorted(n for n, f in tables.items() if n not in SHARED and "firm_id" not in f().columns)


