"""What a plan proves of the firm, what the catalog tells at start, and the intent log."""

import itertools

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import determine, filings, views
from ledgerloom.rules import RuleSet
from ledgerloom.session import FirmSession, MissingFirm, catalog_facts, start_up_check, unproved


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    """Three tenant tables and a shared one, as files."""
    d = tmp_path_factory.mktemp("tenants")
    lines = spark.range(40).selectExpr(
        "cast(id % 3 as int) firm_id", "cast(id % 4 as int) client_id", "concat('t', id) line_id", "'A, LLC' name_raw", "concat('N', id % 5) name_norm", "if(id % 2 = 0, 'x', null) tin_bidx", "'PRESENT' tin_status", "'0001' tin_last4", "2025 tax_year", "id * 100 amount_cents", "0L withholding_cents", "false is_card", "'PAYMENT' entry_type", "'SERVICES' expense_class", "false deleted"
    )
    lines.write.parquet(str(d / "ledger.parquet"))
    spark.range(6).selectExpr("cast(id % 3 as int) firm_id", "cast(id % 4 as int) client_id", "concat('NAME:N', id) alias_key", "'ALIAS:1' canonical_key").write.parquet(str(d / "aliases.parquet"))
    spark.range(3).selectExpr("cast(id as int) client_id", "'r' reason").write.parquet(str(d / "reason_code.parquet"))
    read = lambda name: (lambda: spark.read.parquet(str(d / f"{name}.parquet")))
    return {n: read(n) for n in ("ledger", "aliases", "reason_code")}


def test_a_forgotten_filter_is_told(spark, stored):
    s = FirmSession(spark, stored, 1)
    mine, every = s.table("ledger"), stored["ledger"]()
    assert unproved(mine, 1) == [] and unproved(mine, 2) == ["ledger"] and unproved(every, 1) == ["ledger"]
    with pytest.raises(MissingFirm, match="ledger"):
        s.proved(every)
    told = {
        "join on the firm": (mine.join(every.select("firm_id", "line_id", F.col("amount_cents").alias("b")), ["firm_id", "line_id"]), []),
        "join without it": (mine.join(every.select("line_id", F.col("amount_cents").alias("b")), "line_id"), ["ledger"]),
        "union": (mine.unionByName(every), ["ledger"]),
        "filter above a grouping by firm": (every.groupBy("firm_id").count().filter("firm_id = 1"), []),
        "filter above a total": (every.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("client_id"))).filter("firm_id = 1"), ["ledger"]),
        "or": (every.filter("firm_id = 1 or client_id = 2"), ["ledger"]),
        "renamed": (every.withColumnRenamed("firm_id", "f").filter("f = 1"), []),
        "shared": (mine.join(s.table("reason_code"), "client_id"), []),
        "anti join": (mine.join(every.select("line_id"), "line_id", "left_anti"), ["ledger"]),
    }
    every.createOrReplaceTempView("everyone")
    mine.createOrReplaceTempView("mine")
    told["subquery"] = (spark.sql("select * from mine where amount_cents > (select avg(amount_cents) from everyone)"), ["ledger"])
    told["own subquery"] = (spark.sql("select * from mine where amount_cents > (select avg(amount_cents) from mine)"), [])
    assert {k: unproved(df, 1) for k, (df, _) in told.items()} == {k: want for k, (_, want) in told.items()}


def test_the_librarys_operators_are_proved(spark, stored):
    s = FirmSession(spark, stored, 1)
    classified, decided = determine.determine(s.table("ledger"), s.table("aliases"), RuleSet(2025, 100))
    planned = filings.plan(decided)
    attention = planned.select("firm_id", "client_id", F.lit("FILING").alias("entity_type"), F.col("filing_id").alias("entity_id"), F.lit("X").alias("type"), F.lit(5).alias("severity"), F.lit(None).cast("int").alias("resolved_at"))
    frames = [classified, decided, planned, determine.exceptions(decided), determine.unreconciled(classified, decided), filings.upsert(planned, planned), filings.freeze_violations(planned, planned), views.open_exceptions(attention, determine.exceptions(decided), planned), views.status_counts(planned), filings.seal(planned, 5)]
    assert [unproved(f, 1) for f in frames] == [[]] * len(frames)
    assert set(unproved(determine.determine(stored["ledger"](), s.table("aliases"), RuleSet(2025, 100))[1], 1)) == {"ledger"}


def test_the_catalog_tells_a_table_without_a_firm(spark, stored):
    spark.sql("create database if not exists tenancy_check")
    try:
        stored["ledger"]().createOrReplaceTempView("tenant_ledger")
        before = {n for n, _, guarded, allowed in catalog_facts(spark, "tenancy_check") if not (guarded or allowed)}
        spark.range(3).createOrReplaceTempView("registered_at_run_time")
        facts = {n: (columns, guarded) for n, columns, guarded, _ in catalog_facts(spark, "tenancy_check")}
        assert facts["tenant_ledger"] == (15, True) and facts["registered_at_run_time"] == (1, False)
        with pytest.raises(MissingFirm, match="registered_at_run_time"):
            start_up_check(spark, "tenancy_check")
        start_up_check(spark, "tenancy_check", frozenset(before | {"registered_at_run_time"}))
    finally:
        for v in ("tenant_ledger", "registered_at_run_time", "everyone", "mine"):
            spark.catalog.dropTempView(v)
        spark.sql("drop database tenancy_check cascade")


def fold(events):
    """The state after a list of events, one at a time."""
    state, was, holds, legal = filings.AFTER_EVENT[None], None, False, True
    for e, arrived in events:
        if e == "CALL":
            holds |= arrived
            legal = was == "INTENT"
        else:
            legal = e in filings.FOLLOWS[was]
            state, was = filings.AFTER_EVENT[e], e
    return (*state, holds, legal, not (holds and state[2] in ("PLAN", "DISPATCH")))


def test_every_crash_point_at_once(spark):
    """Wherever a run dies the log says how to go on, and going on sends nothing twice."""
    runs = {
        "plain": "SEAL INTENT CALL RECEIPT ACKS SETTLE", "answer lost": "SEAL INTENT CALL UNKNOWN FOUND ACKS SETTLE", "never came": "SEAL INTENT CALL- UNKNOWN ABSENT", "died before the call": "SEAL INTENT ABSENT", "nothing": "SEAL",
        "no barrier": "SEAL CALL INTENT RECEIPT", "released what came": "SEAL INTENT CALL UNKNOWN ABSENT",
    }
    logs = {(f, k): [(e.rstrip("-"), not e.endswith("-")) for e in text.split()] for f, (k, text) in itertools.product((1, 2), runs.items())}
    rows = [(f, k, 3 * i + f, e, a if e == "CALL" else None) for (f, k), log in logs.items() for i, (e, a) in enumerate(log)]
    got = {(r.firm_id, r.batch_id, r.position): (r.batch_state, r.filing_state, r.recovery, r.endpoint_holds, r.legal, r.safe) for r in filings.replay(spark.createDataFrame(rows, "firm_id int, batch_id string, seq long, event string, arrived boolean").repartition(3)).collect()}
    assert got == {(f, k, n): fold(log[:n]) for (f, k), log in logs.items() for n in range(len(log) + 1)}
    for k in ("plain", "answer lost", "never came", "died before the call", "nothing"):
        assert all(v[4] and v[5] for (_, name, _), v in got.items() if name == k)
    assert not got[1, "no barrier", 2][4] and not got[1, "released what came", 5][5]
    assert got[1, "plain", 3][:3] == got[1, "answer lost", 4][:3] == ("DISPATCHED", "SUBMITTED_UNACKNOWLEDGED", "RECONCILE")  # recorded but crashed, recorded but told otherwise: one state
