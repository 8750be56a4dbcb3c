"""Stored state: commits, write-back by parts, digests, aborted imports, views kept by deltas."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import determine, upkeep, views
from ledgerloom.rules import RuleSet
from ledgerloom.sources import export
from ledgerloom.store import ConcurrentCommit, Store
from tests.test_export import GOOD_QB, GOOD_SHEET, write

RULES = RuleSet(2025, 60_000)
EVERY = lambda prefix: F.lit(True)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def files(store, name):
    return {k: sorted(p.name for f in fs for p in Path(f"{store.root}/{f}".removeprefix("file://")).glob("part-*")) for k, fs in store.parts(name).items()}


def payments(spark, n=400, seed=1, clients=12):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        vendor = r.randint(1, 9)
        rows.append((1 + i % 2, r.randint(1, clients), "XERO", f"t{i}", f"Vendor {vendor}", f"VENDOR {vendor}", f"x{vendor}" if vendor % 3 else None, "PRESENT" if vendor % 3 else "MISSING", "0001" if vendor % 3 else None, r.choice([2024, 2025, 2025]), r.randint(-900, 60_000), 0, False, "PAYMENT", "SERVICES"))
    schema = "firm_id int, client_id int, source_system string, source_txn_id string, name_raw string, name_norm string, tin_bidx string, tin_status string, tin_last4 string, tax_year int, amount_cents long, withholding_cents long, is_card boolean, entry_type string, expense_class string"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("row_hash", F.sha2(F.to_json(F.struct(*df.columns)), 256))


def no_aliases(spark):
    return spark.createDataFrame([], "firm_id int, client_id int, alias_key string, canonical_key string")


def changed(source, when, more=1):
    out = source.withColumn("amount_cents", F.when(F.expr(when), F.col("amount_cents") + more).otherwise(F.col("amount_cents")))
    return out.withColumn("row_hash", F.sha2(F.to_json(F.struct(*[c for c in out.columns if c != "row_hash"])), 256))


def same(a, b):
    cols = sorted(set(a.columns) - {"bucket"})
    return a.select(*cols).exceptAll(b.select(*cols)).isEmpty() and b.select(*cols).exceptAll(a.select(*cols)).isEmpty()


def test_a_transaction_is_all_or_nothing(spark, store, tmp_path):
    rows = spark.range(60).selectExpr("cast(id % 3 as int) firm_id", "id client_id", "id v")
    with store.transaction() as t:
        t.replace("a", upkeep.cut(rows, 4), upkeep.BY, salts=2)
        t.append("log", spark.range(2))
    with pytest.raises(RuntimeError), store.transaction() as t:
        t.append("log", spark.range(5))
        t.replace("a", upkeep.cut(rows.limit(1), 4), upkeep.BY)
        raise RuntimeError
    assert (store.version(), store.read("log").count(), store.read("a").count()) == (1, 2, 60)
    assert len(list((tmp_path / "store" / "data").iterdir())) == 1  # the aborted files are gone
    before = files(store, "a")
    with store.transaction() as t:
        t.overwrite("a", upkeep.cut(rows, 4).filter("firm_id = 1 and bucket = 2").withColumn("v", F.lit(7).cast("long")), [("1", "2"), ("2", "0")])
    after = files(store, "a")
    assert {k for k in before if before[k] != after.get(k)} == {("1", "2"), ("2", "0")} and ("2", "0") not in after
    assert {r.v for r in store.read("a", [("1", "2")]).collect()} == {7} and store.read("a", version=1).count() == 60
    with pytest.raises(ValueError), store.transaction() as t:
        t.overwrite("a", upkeep.cut(rows, 4), [("0", "0")])
    with pytest.raises(ConcurrentCommit), store.transaction() as t:
        t.append("log", spark.range(1))
        with Store(spark, store.root).transaction() as other:
            other.append("log", spark.range(1))
    assert store.read("log").count() == 3


def test_an_incremental_run_writes_back_its_parts_and_equals_the_full_run(spark, store):
    first = payments(spark)
    upkeep.apply_source(store, first, EVERY, 1)
    assert len(upkeep.refresh_decisions(store, no_aliases(spark), RULES)) == len(store.parts("snapshot"))
    before, kept = files(store, "decisions"), files(store, "snapshot")
    second = changed(first, "client_id in (3, 5) and firm_id = 1").filter("not (client_id = 7 and firm_id = 2)")
    applied = upkeep.apply_source(store, second, EVERY, 2)
    parts = upkeep.refresh_decisions(store, no_aliases(spark), RULES)
    assert set(parts) == set(applied.parts) and 0 < len(parts) <= 3
    assert all(before[k] == files(store, "decisions")[k] for k in before if k not in parts) and all(kept[k] == files(store, "snapshot")[k] for k in kept if k not in parts)
    full = determine.determine(second.withColumn("deleted", F.lit(False)), no_aliases(spark), RULES)[1]
    assert same(store.read("decisions"), full) and store.read("dirty").isEmpty()
    version = store.version()
    assert upkeep.refresh_decisions(store, no_aliases(spark), RULES) == [] and store.version() == version
    other = RuleSet(2024, 60_000)
    upkeep.apply_source(store, changed(second, "client_id = 1"), EVERY, 3)
    assert upkeep.refresh_decisions(store, no_aliases(spark), RULES) and not store.read("watermarks").filter("marked_at = 3").isEmpty()
    assert other.tax_year == 2024


def test_a_change_of_another_year_reaches_the_decision(spark, store):
    first = payments(spark)
    upkeep.apply_source(store, first, EVERY, 1)
    upkeep.refresh_decisions(store, no_aliases(spark), RULES)
    second = changed(first, "tax_year = 2024 and client_id = 4", 100)
    upkeep.apply_source(store, second, EVERY, 2)
    upkeep.refresh_decisions(store, no_aliases(spark), RULES)
    assert same(store.read("decisions"), determine.determine(second.withColumn("deleted", F.lit(False)), no_aliases(spark), RULES)[1])


def test_an_unchanged_source_touches_no_file(spark, store):
    source = payments(spark)
    upkeep.apply_source(store, source, EVERY, 1)
    was, version = files(store, "snapshot"), store.version()
    assert upkeep.apply_source(store, source.repartition(7), EVERY, 2).parts == [] and (files(store, "snapshot"), store.version()) == (was, version)
    some = upkeep.declared([2], ["XERO"], [2025])
    part = source.filter("client_id = 2 and tax_year = 2025")
    assert upkeep.apply_source(store, part, some, 3).parts == []  # what lies outside of its scope may be absent
    assert upkeep.apply_source(store, part.limit(0), some, 4).counts["tombstoned"] == part.count()
    assert upkeep.apply_source(store, part, some, 5).counts["resurrected"] == part.count()


def test_an_aborted_import_keeps_its_rejections_and_leaves_the_book(spark, store, tmp_path, monkeypatch):
    d = write(tmp_path / "in", GOOD_QB + "TBD,A,,1.00,check,C-1,X,m,,\n", GOOD_SHEET)
    m = export.read_manifest(spark, d)
    judged = export.judge(export.read_payments(spark, f"{d}/payments-quickbooks.csv", "QUICKBOOKS"), export.read_clients(spark, d)).persist()
    scope = upkeep.declared(list(m.client_refs), ["QUICKBOOKS"], list(m.covered_years))
    upkeep.import_judged(store, judged, 1, b"k", scope, 1, most_rejected=0.5)
    was = files(store, "snapshot")
    with pytest.raises(export.TooManyRejections):
        upkeep.import_judged(store, judged, 1, b"k", scope, 2)
    assert files(store, "snapshot") == was and store.read("rejections").filter("run_id = 2").count() == 1
    monkeypatch.setattr(upkeep.M, "dirty_units", lambda changes: 1 / 0)  # dies in the merge
    with pytest.raises(ZeroDivisionError):
        upkeep.import_judged(store, judged.withColumn("cents", F.col("cents") + 1), 1, b"k", scope, 3, most_rejected=0.5)
    assert files(store, "snapshot") == was and store.read("rejections").filter("run_id = 3").count() == 1
    states = {(r.run_id, r.state) for r in store.read("runs").collect()}
    assert states == {(1, "RUNNING"), (1, "COMPLETED"), (2, "RUNNING"), (2, "FAILED"), (3, "RUNNING"), (3, "FAILED")}


STATES = ["BLOCKED", "READY_TO_TRANSMIT", "BATCHED", "SUBMITTED_UNACKNOWLEDGED", "ACCEPTED", "REJECTED"]
FILING = "firm_id int, client_id int, tax_year int, filing_id string, state string, amount_cents long, vendor_key string, severity int, resolved_at int"


def test_counts_kept_by_random_deltas_equal_recomputation(spark, store):
    r = random.Random(8)
    rows = {i: (r.randint(1, 2), r.randint(1, 6), r.choice([2024, 2025]), f"f{i}", r.choice(STATES), r.randint(1, 99), f"v{i}", 5, None) for i in range(80)}
    old = spark.createDataFrame(list(rows.values()), FILING)
    key = ["firm_id", "client_id", "tax_year"]
    upkeep.move_counts(store, "status", views.status_counts(old), key)
    for _ in range(3):
        for i in r.sample(sorted(rows), 15):
            f = rows.pop(i)
            if r.random() < 0.8:
                rows[i] = (*f[:4], r.choice(STATES), f[5] + r.randint(0, 1), *f[6:])
        n = 1_000 + r.randint(0, 10**6)
        rows[n] = (1, 6, 2025, f"f{n}", "ACCEPTED", 5, "v", 5, None)
        new = spark.createDataFrame(list(rows.values()), FILING)
        upkeep.move_counts(store, "status", upkeep.status_deltas(upkeep.status_moves(old, new)), key)
        assert same(store.read("status"), views.status_counts(new))
        old = new
    assert upkeep.move_counts(store, "status", upkeep.status_deltas(upkeep.status_moves(old, old)), key) == []


def test_two_firms_with_equal_ids_stay_apart(spark):
    clients = spark.createDataFrame([(1, 7, "One"), (2, 7, "Two")], "firm_id int, client_id int, legal_name string")
    filings = spark.createDataFrame([(1, 7, 2025, "f", "ACCEPTED", 10, "v", 0, None), (2, 7, 2025, "f", "BLOCKED", 20, "v", 0, None)], FILING)
    attention = spark.createDataFrame([(2, 7, "FILING", "f", "VENDOR_MISSING_TIN", 5, None)], "firm_id int, client_id int, entity_type string, entity_id string, type string, severity int, resolved_at int")
    got = views.client_status(clients, spark.createDataFrame([(2025,)], "tax_year int"), filings, attention)
    assert {(r.firm_id, r.status, r.n_attention) for r in got.collect()} == {(1, "FULLY_FILED", 0), (2, "NEEDS_ATTENTION", 1)}
    raised = spark.createDataFrame([(f, 7, "v", 2025, "MISSING_TIN", "BLOCKING") for f in (1, 2)], "firm_id int, client_id int, vendor_key string, tax_year int, code string, severity string")
    told = {(r.firm_id, r.code) for r in views.open_exceptions(attention, raised, filings).collect()}
    assert told == {(2, "VENDOR_MISSING_TIN"), (1, "MISSING_TIN")}


def test_stored_relations_follow_their_tables(spark, tmp_path):
    import shutil

    from ledgerloom.plans.book import Book
    from ledgerloom.plans.queries import QUERIES

    d = tmp_path / "tables"
    d.mkdir()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", d / f"{t}.parquet")
    query = QUERIES["flt4_nothing_dirty"]
    before = query(spark, str(d)).agg(F.sum("vendors")).first()[0]
    spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").filter("l_orderkey % 2 = 0").coalesce(1).write.parquet(str(tmp_path / "half"))
    shutil.copy(next((tmp_path / "half").glob("part-*.parquet")), d / "lineitem.parquet")
    after = query(spark, str(d)).agg(F.sum("vendors")).first()[0]
    assert before == Book(spark, "/root/testdata/sf0.001").decided.count() != after == Book(spark, str(d)).decided.count()


def test_a_directory_imported_twice_changes_nothing(spark, store, tmp_path):
    d = write(tmp_path / "in", GOOD_QB, GOOD_SHEET)
    first = upkeep.import_directory(store, d, 1, b"k", 1)
    assert first.counts == {"inserted": 6} and store.read("snapshot").filter("not deleted").count() == 6
    was = files(store, "snapshot")
    assert upkeep.import_directory(store, d, 1, b"k", 2).parts == [] and files(store, "snapshot") == was
    less = write(tmp_path / "less", GOOD_QB.split("\n", 1)[1], GOOD_SHEET)
    again = upkeep.import_directory(store, less, 1, b"k", 3)
    assert again.counts["tombstoned"] == 1 and {r.state for r in store.read("runs").filter("run_id = 3").collect()} == {"RUNNING", "COMPLETED"}
