"""What imports and stored state cost: readings of a source, jobs of an export, shuffle files and old parts that stay."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import scalars as S
from ledgerloom.operators import upkeep
from ledgerloom.plans.book import Book
from ledgerloom.session import writing
from ledgerloom.sources import generator, writer
from ledgerloom.store import Store
from tests.test_upkeep import EVERY, changed, files, payments, same


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.size()))


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_first_import_reads_its_source_once(spark, store, monkeypatch):
    """no join with an empty snapshot, no reading beforehand to learn the parts."""
    source, seen = payments(spark), spark.sparkContext.accumulator(0)
    counted = source.mapInArrow(lambda batches: (seen.add(b.num_rows) or b for b in batches), source.schema)
    monkeypatch.setattr(upkeep.M, "diff", None)
    applied = upkeep.apply_source(store, counted, EVERY, 1)
    assert seen.value == source.count() and applied.counts == {"inserted": source.count()}
    assert same(store.read("snapshot"), source.withColumn("deleted", F.lit(False))) and sorted(applied.parts) == sorted(store.parts("snapshot"))
    assert same(store.read("digests"), upkeep.digests(upkeep.cut(source)))
    assert same(store.read("dirty"), source.select("firm_id", "client_id", "tax_year").distinct().withColumn("marked_at", F.lit(1)))


def test_an_empty_first_source_commits_nothing(spark, store, tmp_path):
    assert upkeep.apply_source(store, payments(spark).limit(0), EVERY, 1).parts == []
    assert store.version() == 0 and not list((tmp_path / "store" / "data").glob("*"))


def test_names_are_normalized_in_one_reading_without_a_join(spark):
    """F2"""
    raw = spark.createDataFrame([("José Núñez",), ("Acme, LLC",), (None,), ("",), ("ﬁlms",), ("José Núñez",)], "raw string")
    got = S.normalize_names(raw, "raw", "norm")
    assert "Join" not in plan(got)
    assert sorted(r.norm for r in got.collect()) == ["", "", "ACME", "FILMS", "JOSE NUNEZ", "JOSE NUNEZ"]


@pytest.mark.parametrize("dialect", S.DATE_FORMATS)
def test_shapes_of_dates_leave_out_no_text_that_a_format_fits(spark, dialect):
    texts = [f"{a}{x}{b}{x}{c}" for x in "/-" for a in ("3", "03", "2025", "+12025", "13", "003") for b in ("4", "04", "Mar", "mar") for c in ("5", "05", "25", "2025", "+12025")]
    rows = spark.createDataFrame([(f" {t}",) for t in texts] + [(t,) for t in ("", "x", "45720", "2025-03-04\n", "3/4/25 ")], "raw string")
    plain = F.coalesce(*[F.try_to_timestamp(F.trim("raw"), F.lit(f)).cast("date") for f in S.DATE_FORMATS[dialect]])
    wrong = rows.filter(plain.isNotNull()).filter(~S.parse_date(F.col("raw"), dialect).eqNullSafe(plain))
    assert wrong.isEmpty() and not rows.filter(plain.isNotNull()).isEmpty()


def test_an_export_of_all_systems_is_dealt_once_and_in_order(spark, tmp_path, monkeypatch):
    """F6"""
    kind, dealt = type(spark.range(1)), []
    deal = kind.repartitionByRange
    monkeypatch.setattr(kind, "repartitionByRange", lambda self, *a: dealt.append(a) or deal(self, *a))
    lines = generator.ledger(spark, generator.Shape(clients_a_firm=2, most_rows=300), copies=2)
    writer.write_export(lines, str(tmp_path / "out"), 2025, [2025])
    assert len(dealt) == 1
    for system, headers in writer.HEADERS.items():
        folder = tmp_path / "out" / f"payments-{system.lower()}.csv"
        text = [x for p in sorted(Path(folder).glob("part-*")) for x in p.read_text().splitlines()]
        assert text[0] == ",".join(h for h, _ in headers) and len(text) - 1 == lines.filter(F.col("source_system") == system).count()
        if system != "SPREADSHEET":
            at = [h for h, _ in headers].index("Txn ID" if system == "QUICKBOOKS" else "PaymentID")
            ids = [r.id for r in spark.createDataFrame([(i, x) for i, x in enumerate(text[1:])], "i int, x string").select("i", F.regexp_extract("x", r"(?:^|,)([GF]-[^,]*)", 1).alias("id")).orderBy("i").collect()]
            assert at > 0 and ids == sorted(ids) and all(ids)


def test_shuffle_files_go_with_the_write(spark, tmp_path):
    """what is stored for later queries leaves no shuffle files behind, whenever the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(name)
    book, before = Book(spark, "/root/testdata/sf0.001"), shuffle_files(spark)
    book.stored("footprint", lambda: book.changes.groupBy("change").count())
    assert shuffle_files(spark) <= before and spark.conf.get(name) == own
    with pytest.raises(ZeroDivisionError), writing(spark):
        1 / 0
    assert spark.conf.get(name) == own


def test_vacuum_leaves_the_current_commit_alone(spark, store, tmp_path):
    """parts that no later commit names go, those of other commits and of open transactions stay."""
    rows = upkeep.cut(spark.range(60).selectExpr("cast(id % 3 as int) firm_id", "id client_id", "id v"), 4)
    with store.transaction() as t:
        t.replace("a", rows, upkeep.BY)
    with store.transaction() as t:
        t.overwrite("a", rows.filter("firm_id = 1 and bucket = 2").withColumn("v", F.lit(7).cast("long")), [("1", "2")])
    now = files(store, "a")
    with store.transaction() as t:
        t.append("log", spark.range(3))
        old = sum(1 for _ in (tmp_path / "store" / "data").rglob("part-*"))
        store.vacuum()
        assert sum(1 for _ in (tmp_path / "store" / "data").rglob("part-*")) < old
    assert files(store, "a") == now and store.read("a").count() == 60 and store.read("log").count() == 3
    assert len(list((tmp_path / "store" / "commits").glob("*.json"))) == 2


def test_a_merge_keeps_one_copy_of_a_row(spark, store, monkeypatch):
    """what is written between join and snapshot holds no row twice."""
    source, widths = payments(spark), []
    upkeep.apply_source(store, source, EVERY, 1)
    drop = upkeep.drop_scratch
    monkeypatch.setattr(upkeep, "drop_scratch", lambda spark, where: widths.append(spark.read.parquet(where).columns) or drop(spark, where))
    applied = upkeep.apply_source(store, changed(source, "client_id = 3").filter("client_id <> 5"), EVERY, 2)
    assert len(widths) == 1 and len(widths[0]) == len(source.columns) + 3
    assert applied.counts["updated"] == source.filter("client_id = 3").count() and applied.counts["tombstoned"] == source.filter("client_id = 5").count()
    assert {(r.client_id, r.tax_year) for r in store.read("dirty").filter("marked_at = 2").collect()} == {(r.client_id, r.tax_year) for r in source.filter("client_id in (3, 5)").select("client_id", "tax_year").distinct().collect()}
