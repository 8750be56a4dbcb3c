import random
from datetime import date

import pytest

from ledgerloom.operators import determine as D
from ledgerloom.rules import RuleSet

RULES = RuleSet(2025, 60_000)
SCHEMA = "firm_id int, client_id int, line_id string, name_raw string, name_norm string, tin_bidx string, tin_status string, tin_last4 string, payment_date date, tax_year int, amount_cents long, withholding_cents long, is_card boolean, entry_type string, expense_class string, deleted boolean"
ALIAS = "firm_id int, client_id int, alias_key string, canonical_key string"


def line(i, name, tin, day, cents, card=False, held=0, entry=None, cls="SERVICES", client=1, status=None):
    return (1, client, f"L{i}", name, name.upper(), tin, status or ("PRESENT" if tin else "MISSING"), tin and "1234", day, day.year, cents, held, card, entry or ("REVERSAL" if cents < 0 else "PAYMENT"), cls, False)


def decide(spark, rows, aliases=()):
    work, out = D.determine(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(list(aliases), ALIAS), RULES)
    assert D.unreconciled(work, out).isEmpty()
    return {r.vendor_key: r for r in out.collect()}, out


def d(m, day):
    return date(2025, m, day)


GOLDEN = [
    ("three_spellings", [("Acme", "T", d(3, 4), 30000), ("Acme", "T", d(7, 19), 25000), ("Acme", "T", d(11, 2), 27500)], (82500, 0, 0, 82500, 0, "THRESHOLD_MET")),
    ("december_reversal", [("R", "T", d(4, 3), 25000), ("R", "T", d(12, 18), 55000), ("R", "T", d(12, 29), -55000)], (80000, 0, 55000, 25000, 0, "BELOW_THRESHOLD")),
    ("exactly_600", [("E", "T", d(2, 20), 19999), ("E", "T", d(6, 11), 20001), ("E", "T", d(10, 8), 20000)], (60000, 0, 0, 60000, 0, "THRESHOLD_MET")),
    ("just_under", [("U", "T", d(4, 17), 29999), ("U", "T", d(9, 5), 30000)], (59999, 0, 0, 59999, 0, "BELOW_THRESHOLD")),
    ("no_tin", [("N", None, d(5, 12), 45000), ("N", None, d(9, 30), 40000)], (85000, 0, 0, 85000, 0, "THRESHOLD_MET")),
    ("card_below", [("C", "T", d(2, 11), 120000, True), ("C", "T", d(5, 6), 70000, True), ("C", "T", d(7, 22), 30000), ("C", "T", d(9, 14), 20000)], (240000, 190000, 0, 50000, 0, "BELOW_THRESHOLD")),
    ("card_above", [("C", "T", d(1, 30), 100000, True), ("C", "T", d(6, 18), 75000, True), ("C", "T", d(8, 9), 40000), ("C", "T", d(11, 21), 25000)], (240000, 175000, 0, 65000, 0, "THRESHOLD_MET")),
    ("withholding", [("W", "T", d(3, 14), 40000, False, 9600)], (40000, 0, 0, 40000, 9600, "BACKUP_WITHHOLDING")),
    ("backfill", [("B", None, d(1, 1), 13000), ("B", None, d(2, 1), 15000), ("B", None, d(3, 1), 12000), ("B", None, d(4, 1), 12000), ("B", "T", d(5, 1), 18000)], (70000, 0, 0, 70000, 0, "THRESHOLD_MET")),
]


@pytest.mark.parametrize(("name", "payments", "want"), GOLDEN)
def test_golden_cases(spark, name, payments, want):
    got, out = decide(spark, [line(i, *p) for i, p in enumerate(payments)])
    assert len(got) == 1
    r = next(iter(got.values()))
    assert (r.gross_cents, r.card_excluded_cents, r.reversal_cents, r.reportable_cents, r.withholding_cents, r.requirement_reason) == want
    codes = {x.code for x in D.exceptions(out).collect()}
    if name == "no_tin":
        assert codes == {"MISSING_TIN"} and r.transmit_blocked and r.identity_source == "NAME_ONLY"
    if name == "backfill":
        assert r.identity_source == "NAME_TIN_PROMOTION" and r.vendor_key == "TIN:T" and r.transmit_blocked


def test_one_name_two_tins_stays_three_vendors(spark):
    pays = [("A", "T1", 45000), ("A", "T1", 35000), ("A", "T2", 52000), ("A", "T2", 28000), ("A", None, 22000), ("A", None, 18000)]
    got, out = decide(spark, [line(i, n, t, d(3, 1 + i), c) for i, (n, t, c) in enumerate(pays)])
    assert {k: r.reportable_cents for k, r in got.items()} == {"TIN:T1": 80000, "TIN:T2": 80000, "NAME:A": 40000}
    assert {(x.vendor_key, x.code) for x in D.exceptions(out).collect()} == {("NAME:A", "AMBIGUOUS_VENDOR_IDENTITY")}


def test_alias_wins_and_other_clients_do_not_mix(spark):
    rows = [line(0, "Z", None, d(1, 2), 70000), line(1, "Z", "T", d(1, 3), 5000, client=2)]
    got, _ = decide(spark, rows, [(1, 1, "NAME:Z", "TIN:Q")])
    assert {k: r.identity_source for k, r in got.items()} == {"TIN:Q": "MANUAL_ALIAS", "TIN:T": "DIRECT_TIN"}


def plain_disposition(year, entry, cls, card, cents, held):
    if year != 2025:
        return "EXCLUDED_OUT_OF_TAX_YEAR"
    if entry == "VOID":
        return "EXCLUDED_VOID"
    if cls != "SERVICES":
        return "EXCLUDED_NON_SERVICES"
    if card:
        return "EXCLUDED_CARD_TPSO"
    if not cents and not held:
        return "EXCLUDED_ZERO_AMOUNT"
    return "COUNTED_REVERSAL" if cents < 0 else "COUNTED"


def test_classifier_equals_plain_python_on_20000_payments(spark):
    r = random.Random(1)
    rows = []
    for i in range(20_000):
        year = r.choice([2024, 2026] + [2025] * 8)
        rows.append((i, year, r.choice(["PAYMENT", "REVERSAL", "REFUND", "VOID"]), r.choice(["SERVICES", "SERVICES", "RENT", "OTHER"]), r.random() < 0.25, r.choice([0, -500, -1, 100, 7, 1, 99, 5]), r.choice([0] * 6 + [12])))
    want = {x[0]: plain_disposition(*x[1:]) for x in rows}
    assert set(want.values()) == {"EXCLUDED_OUT_OF_TAX_YEAR", "EXCLUDED_VOID", "EXCLUDED_NON_SERVICES", "EXCLUDED_CARD_TPSO", "EXCLUDED_ZERO_AMOUNT", "COUNTED_REVERSAL", "COUNTED"}
    df = spark.createDataFrame(rows, "i int, tax_year int, entry_type string, expense_class string, is_card boolean, amount_cents long, withholding_cents long")
    got = {x.i: (x.disposition, x.counted_cents, x.amount_cents) for x in D.classify(df, RULES).collect()}
    assert {k: v[0] for k, v in got.items()} == want
    assert all(c == (a if s.startswith("COUNTED") else 0) for s, c, a in got.values())


def test_incremental_drops_decisions_of_a_client_without_rows(spark):
    rows = [line(0, "A", "T", d(1, 2), 70000), line(1, "B", "S", d(1, 2), 80000, client=2)]
    _, before = decide(spark, rows)
    dirty = spark.createDataFrame([(1, 2, 2025)], "firm_id int, client_id int, tax_year int")
    after = D.incremental(spark.createDataFrame(rows[:1], SCHEMA), spark.createDataFrame([], ALIAS), RULES, dirty, before)
    assert [(x.client_id, x.vendor_key) for x in after.collect()] == [(1, "TIN:T")]
