"""Keyed streaming state against the batch forms, over restarts from the checkpoint."""

import random

import pytest

from ledgerloom.operators import audit, filings
from ledgerloom.streaming import admission, sessions

CALL = "firm_id long, call_id long, at_us long"


@pytest.fixture
def stateful(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name)
    spark.conf.set(name, admission.PROVIDER)
    yield
    spark.conf.set(name, old)


def feed(spark, rows, where):
    spark.createDataFrame(rows, CALL).coalesce(1).write.mode("append").parquet(where)


def drain(spark, make, d, most=None):
    source = spark.readStream.schema(CALL)
    source = source.option("maxFilesPerTrigger", most) if most else source
    make(source.parquet(f"{d}/in")).writeStream.format("parquet").option("path", f"{d}/out").option("checkpointLocation", f"{d}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_admission_goes_on_from_its_checkpoint(spark, tmp_path, stateful):
    """Calls in any order within the delay; the grants that still count are those of before the restart."""
    r = random.Random(3)
    rows = [(r.randint(1, 3), i, i * 40_000_000 + r.randint(0, 300_000_000)) for i in range(240)]
    make = lambda s: admission.admit_stream(s, 600_000_000, 4)
    d = str(tmp_path)
    feed(spark, rows[:90], f"{d}/in")
    drain(spark, make, d)
    some = spark.read.parquet(f"{d}/out").count()
    feed(spark, rows[90:], f"{d}/in")
    feed(spark, [(-1, -1, 10**12)], f"{d}/in")
    drain(spark, make, d)
    got, want = spark.read.parquet(f"{d}/out").filter("firm_id > 0"), filings.admit(spark.createDataFrame(rows, CALL), 600_000_000, 4)
    assert 0 < some < 90 and got.count() == 240 and got.exceptAll(want).isEmpty() and want.filter("not granted").count() > 10


def test_late_calls_are_kept_under_a_label(spark, tmp_path, stateful):
    r = random.Random(4)
    d, batches = str(tmp_path), []
    for k in range(4):
        batches.append([(r.randint(1, 3), 100 * k + i, r.randint(0, 400) + 300 * k - (500 if i % 9 == 0 else 0)) for i in range(40)])
    make = lambda s: sessions.label_stream(s, 150)
    for b in batches:
        feed(spark, b, f"{d}/in")
        drain(spark, make, d)
    table = spark.createDataFrame([(*c, k) for k, b in enumerate(batches) for c in b], f"{CALL}, batch_no int")
    got, want = spark.read.parquet(f"{d}/out"), sessions.label_late(table, 150)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and 0 < got.filter("late").count() < 40
    cut = {(x.firm_id, x.late, x.start_us, x.end_us): x.calls for x in sessions.sessions(got, 25).collect()}
    plain: dict = {}
    for firm, late in {(x.firm_id, x.late) for x in got.collect()}:
        run: list = []
        for t in [*sorted(x.at_us for x in got.collect() if (x.firm_id, x.late) == (firm, late)), 10**9]:
            if run and t - run[-1] > 25:
                plain[firm, late, run[0], run[-1] + 25] = len(run)
                run = []
            run.append(t)
    assert cut == plain and sum(cut.values()) == 160


def test_a_repeated_seq_and_a_missing_begin_are_told(spark):
    rows = [(1, i, "a", "b", f"e{i}", None) for i in range(1, 6)]
    chain = audit.extend(spark.createDataFrame(rows, "firm_id long, seq long, actor string, action string, entity_id string, detail string")).collect()
    check = lambda keep: {(r.seq, r.problem) for r in audit.verify(spark.createDataFrame(keep, spark_schema), heads).collect()}
    spark_schema = audit.extend(spark.createDataFrame(rows, "firm_id long, seq long, actor string, action string, entity_id string, detail string")).schema
    heads = audit.pin_heads(spark.createDataFrame(chain, spark_schema))
    assert check(chain) == set() and check([*chain, chain[2]]) == {(3, "GAP")} and check(chain[1:]) == {(2, "GAP")}
    assert check([]) == {(5, "TRUNCATED")}
