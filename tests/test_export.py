import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.scalars import tin_index
from ledgerloom.operators import merge
from ledgerloom.sources import export

KEY = b"test key"
QB = "Txn Date,Vendor,Vendor Tax ID,Amount,Payment Method,Customer,Txn ID,Memo,Account,Transaction Type\n"
SHEET = "Date Paid,Who,EIN,$,How Paid,Client,Notes,Category\n"


def write(directory, qb, sheet, refs=("C-1", "C-2"), years=(2025,)):
    directory.mkdir(exist_ok=True)
    (directory / "clients.csv").write_text("client_ref,legal_name,ein,address,city,state,postal_code\nC-1,One,9,a,b,CA,1\nC-2,Two,9,a,b,CA,1\n")
    (directory / "payments-quickbooks.csv").write_text(QB + qb)
    with gzip.open(directory / "payments-spreadsheet.csv.gz", "wt") as f:
        f.write(SHEET + sheet)
    (directory / "manifest.json").write_text(json.dumps({"taxYear": 2025, "revision": 0, "clientRefs": list(refs), "coveredTaxYears": list(years), "files": [{"name": "payments-quickbooks.csv", "sourceSystem": "QUICKBOOKS"}, {"name": "payments-spreadsheet.csv.gz", "sourceSystem": "SPREADSHEET"}]}, indent=1))
    return str(directory)


GOOD_QB = '03/04/2025,"Acme Plumbing, LLC",12-3456789,"1,234.56",Check #1042,C-1,Q1,m,,\n12/29/2025,Acme Plumbing LLC,12-3456789,-55.00,ach,C-1,Q2,m,,\n05/06/2024,José Núñez,,10.00,visa,C-2,Q3,m,rent,\n'
GOOD_SHEET = "4-Mar-25,J P Morgan,12-34567,($20.00),cash,C-1,,\n4-Mar-25,J P Morgan,12-34567,($20.00),cash,C-1,other memo,\n45720,Zed,,5,zelle,C-2,,\n"


def test_import_types_identities_and_ids(spark, tmp_path):
    r = export.import_export(spark, write(tmp_path / "a", GOOD_QB, GOOD_SHEET), 7, KEY)
    rows = {(x.source_system, x.line_no): x for x in r.payments.collect()}
    assert (r.rows_read, r.rows_rejected) == (6, 0)
    a = rows["QUICKBOOKS", 2]
    assert (a.name_norm, a.amount_cents, a.method, a.tin_status, a.tin_last4, str(a.payment_date)) == ("ACME PLUMBING", 123456, "CHECK", "PRESENT", "6789", "2025-03-04")
    assert rows["QUICKBOOKS", 3].entry_type == "REVERSAL" and rows["QUICKBOOKS", 4].expense_class == "RENT" and rows["QUICKBOOKS", 4].name_norm == "JOSE NUNEZ"
    s, t = rows["SPREADSHEET", 2], rows["SPREADSHEET", 3]
    assert s.name_norm == "JP MORGAN" and s.amount_cents == -2000 and s.tin_status == "MALFORMED" and s.tin_raw_masked == "***-**-4567"
    assert s.source_txn_id.startswith("H:") and s.source_txn_id != t.source_txn_id
    assert str(rows["SPREADSHEET", 4].payment_date) == "2025-03-04" and rows["SPREADSHEET", 4].method == "UNKNOWN"
    import hashlib
    import hmac

    assert a.tin_bidx == hmac.new(KEY, b"7:123456789", hashlib.sha256).hexdigest()


BAD = [
    ("03/04/2025,A,,1.00\n", "RAGGED_ROW"), ("03/04/2025,A,,1.00,check,,X,m,,\n", "MISSING_CLIENT_REF"), ("03/04/2025,A,,1.00,check,C-999999,X,m,,\n", "UNKNOWN_CLIENT_REF"), ("31/02/2025,A,,1.00,check,C-1,X,m,,\n", "UNPARSEABLE_DATE"),
    ("TBD,A,,x,check,C-1,X,m,,\n", "UNPARSEABLE_DATE"), ("03/04/2025,A,,twelve dollars,check,C-1,X,m,,\n", "UNPARSEABLE_AMOUNT"), ("03/04/2025,A,,12.345,check,C-1,X,m,,\n", "SUB_CENT_AMOUNT"), ("03/04/2025,,,1.00,check,C-1,X,m,,\n", "UNIDENTIFIABLE_VENDOR"),
    ("03/04/2025,,N/A,1.00,check,C-1,X,m,,\n", "UNIDENTIFIABLE_VENDOR"), ("03/04/2025,,000-00-0000,1.00,check,C-1,X,m,,\n", None), ("03/04/2025,A,,$$100,barter,C-1,X,m,,\n", None), ("03/04/2025,A,,0.00,check,C-1,X,m,,\n", None),
]


def test_every_gate_names_its_rows_in_order(spark, tmp_path):
    d = write(tmp_path / "b", "".join(x for x, _ in BAD), "")
    judged = export.judge(export.read_payments(spark, f"{d}/payments-quickbooks.csv", "QUICKBOOKS"), export.read_clients(spark, d))
    got = {x.line_no: x.reject_code for x in judged.collect()}
    assert got == {i + 2: code for i, (_, code) in enumerate(BAD)}
    with pytest.raises(export.TooManyRejections):
        export.guard(judged)
    assert export.guard(judged, 1.0) == (12, 9)
    out = export.rejections(judged, 1).collect()
    assert len(out) == 9 and all(len(x.raw_line_redacted) <= 1027 for x in out)


def test_reimport_changes_nothing_and_a_revision_only_what_it_says(spark, tmp_path):
    d = write(tmp_path / "c", GOOD_QB, GOOD_SHEET)
    first = export.import_export(spark, d, 1, KEY)
    old = spark.createDataFrame(first.snapshot.collect(), first.snapshot.schema)
    again = export.import_export(spark, d, 1, KEY, old)
    assert {x.change for x in again.changes.collect()} == {"unchanged"} and again.dirty.isEmpty()
    assert all(x.ok for x in merge.verify_idempotent(again.changes).collect())
    edited = GOOD_QB.replace("-55.00", "-56.00").replace('03/04/2025,"Acme Plumbing, LLC",12-3456789,"1,234.56",Check #1042,C-1,Q1,m,,\n', "").replace("C-2,Q3,m", "C-2,Q3,another memo") + "06/01/2025,New,,9.00,cash,C-2,Q9,,,\n"
    rev = export.import_export(spark, write(tmp_path / "d", edited, GOOD_SHEET), 1, KEY, old)
    assert {x.source_txn_id: x.change for x in rev.changes.collect() if x.source_system == "QUICKBOOKS"} == {"Q1": "tombstoned", "Q2": "updated", "Q3": "unchanged", "Q9": "inserted"}
    assert {(x.client_id, x.tax_year) for x in rev.dirty.collect()} == {("C-1", 2025), ("C-2", 2025)}
    third = export.import_export(spark, d, 1, KEY, spark.createDataFrame(rev.snapshot.collect(), rev.snapshot.schema))
    assert {x.source_txn_id: x.change for x in third.changes.collect() if x.source_system == "QUICKBOOKS"} == {"Q1": "resurrected", "Q2": "updated", "Q3": "unchanged", "Q9": "tombstoned"}


def test_rows_outside_the_declared_scope_are_never_tombstoned(spark, tmp_path):
    first = export.import_export(spark, write(tmp_path / "e", GOOD_QB, GOOD_SHEET), 1, KEY)
    old = spark.createDataFrame(first.snapshot.collect(), first.snapshot.schema)
    rev = export.import_export(spark, write(tmp_path / "f", "", "", refs=("C-1",)), 1, KEY, old)
    got = {(x.source_system, x.client_id): x.change for x in rev.changes.collect()}
    assert got == {("QUICKBOOKS", "C-1"): "tombstoned", ("QUICKBOOKS", "C-2"): "untouched", ("SPREADSHEET", "C-1"): "tombstoned", ("SPREADSHEET", "C-2"): "untouched"}


def test_dialects():
    assert export.detect(["Txn Date", "Vendor", "Customer"], None) == "QUICKBOOKS"
    assert export.detect(["a", "b"], "xero") == "XERO" and export.detect(["a"], None) == "CANONICAL"
    assert export.canonical_headers(["Date Paid", "Date", " WHO ", "odd-name x"], "SPREADSHEET") == ["payment_date", "_again_1", "vendor_name", "odd_name_x"]


def test_blind_index_is_scoped(spark):
    from pyspark.sql import functions as F

    r = spark.range(1).select(tin_index(KEY, F.lit(1), F.lit("1")).alias("a"), tin_index(KEY, F.lit(2), F.lit("1")).alias("b")).first()
    assert r.a != r.b


def test_deterministic_csv(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "i int, s string").repartition(2)
    outs = []
    for k in "xy":
        digest = export.write_csv(df, str(tmp_path / k), ["i"])
        outs.append(next((tmp_path / k).glob("part-*.csv")).read_bytes())
    assert outs[0] == outs[1] == b"i,s\n1,a\n2,b\n" and digest == hashlib.sha256(outs[0]).hexdigest()


def test_records_that_break_within_quotes(spark, tmp_path):
    body = 'Txn Date,Vendor,Amount,Customer,Memo\n01/02/2025,"Two\nlines, ""quoted""",1.00,C-1,m\n01/03/2025,Plain,2.00,C-1,"three\n\nlines"\n01/04/2025,Last,3.00,C-1,x\n01/05/2025,Stray" quote,4.00,C-1,x\n'
    p = tmp_path / "payments.csv"
    p.write_text(body)
    got = {r.line_no: (r.vendor_name, r.memo, r.n_fields) for r in export.read_payments(spark, str(p), None).collect()}
    assert got == {2: ('Two\nlines, "quoted"', "m", 5), 4: ("Plain", "three\n\nlines", 5), 7: ("Last", "x", 5), 8: ('Stray" quote', "x", 5)}
    wide = tmp_path / "wide.csv"
    wide.write_text(",".join(f"c{i}" for i in range(65)) + "\n")
    with pytest.raises(ValueError):
        export.read_payments(spark, str(wide), None)


def test_generated_ledger_is_the_same_however_it_is_made_and_decides_as_planted(spark, tmp_path):
    from ledgerloom.operators import determine as D
    from ledgerloom.rules import RuleSet
    from ledgerloom.sources import generator, writer

    shape = generator.Shape(clients_a_firm=3, most_rows=600)
    lines = generator.ledger(spark, shape, copies=6)
    total = lambda d: d.agg(F.count(F.lit(1)), F.sum("amount_cents"), F.bit_xor(F.xxhash64(*lines.columns))).first()
    assert total(lines) == total(lines.repartition(5)) and total(lines) != total(generator.ledger(spark, generator.Shape(seed=43, clients_a_firm=3, most_rows=600), 6))
    sizes = {r.client_id: r.n for r in lines.filter("fixture is null").groupBy("client_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert len(sizes) == 6 and min(sizes.values()) >= shape.least_rows and max(sizes.values()) <= 600
    share = lambda c: lines.filter("fixture is null").agg(F.avg(F.expr(c).cast("double"))).first()[0]
    assert abs(share("method = 'CHECK'") - 0.35) < 0.04 and abs(share("tax_year <> 2025") - 0.06) < 0.03 and abs(share("expense_class <> 'SERVICES'") - 0.18) < 0.04
    d = str(tmp_path / "out")
    writer.write_export(lines, d, 2025, [2024, 2025, 2026], revision=3, gzip=True, fixtures=generator.expected(spark, 6))
    assert export.read_manifest(spark, d).revision == 3 and "three_spellings" in export.read_text(spark, f"{d}/fixtures.json")
    got = export.import_export(spark, d, 1, KEY)
    assert got.rows_read == lines.count() and got.rows_rejected == lines.filter("defect is not null").count() > 0
    decided = D.determine(got.snapshot, spark.createDataFrame([], "firm_id int, client_id string, alias_key string, canonical_key string"), RuleSet(2025, 60_000))[1]
    own = decided.withColumn("fixture", F.regexp_extract("display_name", "^Fixture ([a-z_0-9]+) [0-9]", 1)).filter("fixture <> ''")
    sums = own.groupBy("fixture").agg(*[F.sum(c).alias(c) for c in ("gross_cents", "card_excluded_cents", "reversal_cents", "reportable_cents", "withholding_cents")], F.count(F.lit(1)).alias("vendors"), F.max_by("requirement_reason", "reportable_cents").alias("reason"))
    want = {case: (*(6 * x for x in of), 6 * vendors, reason) for case, _, of, vendors, reason in generator.CASES}
    assert {r.fixture: tuple(r)[1:] for r in sums.collect()} == want
    again = export.import_export(spark, d, 1, KEY, got.snapshot.persist())
    assert {x.change for x in again.changes.collect()} == {"unchanged"}
    later = generator.revised(lines, 7)
    assert 0 < later.exceptAll(lines).count() < 0.05 * lines.count() and lines.count() > later.count()
