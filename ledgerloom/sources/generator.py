"""A synthetic ledger of any size, with planted cases whose decisions are known.

Every value is a function of the seed, the name of what is drawn and the row's
own numbers (hashes, no state), so rows are made in parallel, in any order and
partitioning, and come out the same. Clients are a range; a client's payments
are exploded from their count, which ``Shape`` bounds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Shape:
    """Counts and shares of a generated ledger (fixed values where they have a default)."""

    seed: int = 42
    firms: int = 2
    clients_a_firm: int = 250
    tax_year: int = 2025
    rows_log_mean: float = 7.3
    rows_log_spread: float = 0.85
    least_rows: int = 40
    most_rows: int = 25_000
    rows_a_vendor: float = 18.0
    least_vendors: int = 5
    most_vendors: int = 1_500
    vendor_spread: float = 0.45
    vendor_exponent: float = 0.65
    most_a_vendor: int = 260
    blank_number: float = 0.12
    bare_number: float = 0.03
    reversal: float = 0.04
    reversal_in_december: float = 0.60
    out_of_year: float = 0.06
    system_switch: float = 0.02
    defect: float = 0.008
    withholding: float = 0.24
    withheld_vendors: float = 0.015
    non_services: float = 0.18
    amount_log_mean: float = math.log(45_000)
    amount_log_spread: float = 1.1
    least_cents: int = 500
    most_cents: int = 5_000_000


# Methods with their shares in hundredths, systems, and kinds of planted defects.
METHOD_SHARES = (("CHECK", 35), ("ACH", 30), ("CREDIT_CARD", 18), ("TPSO", 7), ("WIRE", 5), ("CASH", 3), ("UNKNOWN", 2))
SYSTEMS = ("QUICKBOOKS", "XERO", "SPREADSHEET")
DEFECTS = ("amount", "date", "client", "subcent", "noclient", "currency", "vendor")

# Fixed values, the planted cases: (case, payments (name suffix, number, month, cents, card, withheld), (gross, card, reversal, reportable, withheld) cents, vendors, reason).
CASES = (
    ("three_spellings", (("a", 1, 3, 30_000, False, 0), ("b", 1, 7, 25_000, False, 0), ("c", 1, 11, 27_500, False, 0)), (82_500, 0, 0, 82_500, 0), 1, "THRESHOLD_MET"),
    ("december_reversal", (("", 1, 4, 25_000, False, 0), ("", 1, 12, 55_000, False, 0), ("", 1, 12, -55_000, False, 0)), (80_000, 0, 55_000, 25_000, 0), 1, "BELOW_THRESHOLD"),
    ("exactly_600", (("", 1, 2, 19_999, False, 0), ("", 1, 6, 20_001, False, 0), ("", 1, 10, 20_000, False, 0)), (60_000, 0, 0, 60_000, 0), 1, "THRESHOLD_MET"),
    ("just_under", (("", 1, 4, 29_999, False, 0), ("", 1, 9, 30_000, False, 0)), (59_999, 0, 0, 59_999, 0), 1, "BELOW_THRESHOLD"),
    ("no_tin", (("", None, 5, 45_000, False, 0), ("", None, 9, 40_000, False, 0)), (85_000, 0, 0, 85_000, 0), 1, "THRESHOLD_MET"),
    ("backfill", (("", None, 1, 13_000, False, 0), ("", None, 2, 15_000, False, 0), ("", None, 3, 12_000, False, 0), ("", None, 4, 12_000, False, 0), ("", 1, 5, 18_000, False, 0)), (70_000, 0, 0, 70_000, 0), 1, "THRESHOLD_MET"),
    ("one_name_two_tins", (("", 1, 2, 45_000, False, 0), ("", 1, 4, 35_000, False, 0), ("", 2, 6, 52_000, False, 0), ("", 2, 8, 28_000, False, 0), ("", None, 9, 22_000, False, 0), ("", None, 10, 18_000, False, 0)), (200_000, 0, 0, 200_000, 0), 3, "THRESHOLD_MET"),
    ("card_below", (("", 1, 2, 120_000, True, 0), ("", 1, 5, 70_000, True, 0), ("", 1, 7, 30_000, False, 0), ("", 1, 9, 20_000, False, 0)), (240_000, 190_000, 0, 50_000, 0), 1, "BELOW_THRESHOLD"),
    ("card_above", (("", 1, 1, 100_000, True, 0), ("", 1, 6, 75_000, True, 0), ("", 1, 8, 40_000, False, 0), ("", 1, 11, 25_000, False, 0)), (240_000, 175_000, 0, 65_000, 0), 1, "THRESHOLD_MET"),
    ("withholding", (("", 1, 3, 40_000, False, 9_600),), (40_000, 0, 0, 40_000, 9_600), 1, "BACKUP_WITHHOLDING"),
)


def fraction(seed: int, what: str, *by: Column) -> Column:
    """A number in [0, 1) drawn for ``what`` of the row that ``by`` names."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *by), F.lit(1 << 52)).cast("double") / float(1 << 52)


def normal(seed: int, what: str, *by: Column) -> Column:
    u, v = fraction(seed, f"{what}-radius", *by), fraction(seed, f"{what}-angle", *by)
    return F.sqrt(-2.0 * F.log(1.0 - u)) * F.cos(2 * math.pi * v)


def _clipped(value: Column, least: int, most: int) -> Column:
    return F.greatest(F.least(F.round(value), F.lit(float(most))), F.lit(float(least))).cast("long")


def clients(spark: SparkSession, shape: Shape) -> DataFrame:
    """firm_id, client_id, n_rows, n_vendors, source_system, second_system (of a client that changed systems)."""
    s, c = shape, F.col("client_id")
    out = spark.range(shape.firms * shape.clients_a_firm).select((F.col("id") % shape.firms + 1).cast("int").alias("firm_id"), F.col("id").cast("int").alias("client_id"))
    out = out.withColumn("n_rows", _clipped(F.exp(s.rows_log_mean + s.rows_log_spread * normal(s.seed, "rows", c)), s.least_rows, s.most_rows))
    out = out.withColumn("n_vendors", _clipped(F.col("n_rows") / s.rows_a_vendor * F.exp(s.vendor_spread * normal(s.seed, "vendors", c)), s.least_vendors, s.most_vendors))
    which = lambda what: F.element_at(F.array(*map(F.lit, SYSTEMS)), F.floor(fraction(s.seed, what, c) * len(SYSTEMS)).cast("int") + 1)
    return out.withColumns({"source_system": which("system"), "second_system": F.when(fraction(s.seed, "switch", c) < s.system_switch, which("second"))})


def _vendor(shape: Shape) -> Column:
    """A vendor's rank: a power law by inverse transform; a vendor who would get more than ``most_a_vendor`` payments gives the rest to all."""
    c, i, e = F.col("client_id"), F.col("i"), 1.0 - shape.vendor_exponent
    many = F.col("n_vendors").cast("double")
    total = F.pow(many + 1, F.lit(e)) - 1
    rank = F.floor(F.pow(1 + fraction(shape.seed, "vendor", c, i) * total, F.lit(1 / e)))
    expected = F.col("n_rows") * (F.pow(rank + 1, F.lit(e)) - F.pow(rank, F.lit(e))) / total
    other = F.floor(fraction(shape.seed, "other", c, i) * many) + 1
    return F.least(F.when(fraction(shape.seed, "over", c, i) < 1 - shape.most_a_vendor / expected, other).otherwise(rank), F.col("n_vendors")).cast("long")


def _finished(rows: DataFrame, shape: Shape) -> DataFrame:
    """Columns of a ledger from firm_id, client_id, line_id, vendor name and number, date, cents and method."""
    number = F.col("number")
    return rows.select(
        "firm_id", "client_id", "line_id", "source_system", "name_raw", F.upper("name_raw").alias("name_norm"), F.when(number.isNotNull(), F.substring(F.sha2(F.concat(F.lit("tin"), number.cast("string")), 256), 1, 16)).alias("tin_bidx"),
        F.when(number.isNull(), "MISSING").otherwise("PRESENT").alias("tin_status"), F.substring(F.lpad(number.cast("string"), 9, "1"), -4, 4).alias("tin_last4"), F.lpad(number.cast("string"), 9, "1").alias("tin_digits"), "bare_number",
        "payment_date", F.year("payment_date").alias("tax_year"), F.col("amount_cents").cast("long").alias("amount_cents"), F.col("withholding_cents").cast("long").alias("withholding_cents"), "method",
        F.col("method").isin("CREDIT_CARD", "TPSO").alias("is_card"), F.when(F.col("amount_cents") < 0, "REVERSAL").otherwise("PAYMENT").alias("entry_type"), "expense_class", F.lit(False).alias("deleted"), "defect", "fixture",
        F.coalesce(number, F.lit(0)).cast("long").alias("suppkey"), F.pmod(F.xxhash64("line_id"), F.lit(9_000)).cast("int").alias("linenumber"),
    )


def payments(spark: SparkSession, shape: Shape) -> DataFrame:
    """The background ledger, without planted cases; ``defect`` marks the rows that an export spoils."""
    s, c, i = shape, F.col("client_id"), F.col("i")
    rows = clients(spark, shape).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1))).withColumn("v", _vendor(shape))
    of_vendor = lambda what: fraction(s.seed, what, c, F.col("v"))
    of_row = lambda what: fraction(s.seed, what, c, i)
    back = of_row("reversal") < s.reversal
    day = F.make_date(F.lit(s.tax_year), F.lit(1), F.lit(1))
    in_year = F.date_add(day, F.floor(of_row("day") * 365).cast("int"))
    december = F.date_add(F.make_date(F.lit(s.tax_year), F.lit(12), F.lit(1)), F.floor(of_row("day") * 31).cast("int"))
    when = F.when(of_row("outside") < s.out_of_year, F.add_months(in_year, F.when(of_row("before") < 0.5, -12).otherwise(12))).when(back & (of_row("december") < s.reversal_in_december), december).otherwise(in_year)
    cents = _clipped(F.exp(s.amount_log_mean + s.amount_log_spread * normal(s.seed, "amount", c, i)), s.least_cents, s.most_cents)
    method, upto = F.when(F.lit(False), ""), 0
    for name, share in METHOD_SHARES:
        upto += share
        method = method.when(of_row("method") * 100 < upto, name)
    kind = F.element_at(F.array(*map(F.lit, DEFECTS)), F.floor(of_row("kind") * len(DEFECTS)).cast("int") + 1)
    rows = rows.withColumns({
        "line_id": F.concat_ws("-", F.lit("G"), "firm_id", c, i), "source_system": F.when(F.col("second_system").isNotNull() & (F.month(when) > 6), F.col("second_system")).otherwise(F.col("source_system")),
        "name_raw": F.concat(F.lit("Vendor "), c.cast("string"), F.lit(" "), F.col("v").cast("string")), "number": F.when(of_vendor("number") >= s.blank_number, c.cast("long") * 2_000 + F.col("v") + 10_000_000),
        "bare_number": of_vendor("number") >= 1 - s.bare_number, "payment_date": when, "amount_cents": F.when(back, -cents).otherwise(cents), "method": method,
        "withholding_cents": F.when((of_vendor("withheld") < s.withheld_vendors) & ~back, F.round(cents * s.withholding)).otherwise(0), "expense_class": F.when(of_row("class") < s.non_services, "MERCHANDISE").otherwise("SERVICES"),
        "defect": F.when(of_row("defect") < s.defect, kind), "fixture": F.lit(None).cast("string"),
    })
    return _finished(rows, shape)


def fixtures(spark: SparkSession, shape: Shape, copies: int = 25) -> DataFrame:
    """The planted cases, each ``copies`` times, dealt over the firms and their clients."""
    steps = [(case, k, *p) for case, pays, *_ in CASES for k, p in enumerate(pays)]
    table = spark.createDataFrame(steps, "fixture string, k int, suffix string, n int, month int, amount_cents long, card boolean, withholding_cents long")
    rows = spark.range(copies).withColumnRenamed("id", "copy").crossJoin(F.broadcast(table))  # a few dozen rows
    client = F.pmod(F.col("copy"), F.lit(shape.firms * shape.clients_a_firm))
    rows = rows.withColumns({
        "client_id": client.cast("int"), "firm_id": (client % shape.firms + 1).cast("int"), "line_id": F.concat_ws("-", F.lit("F"), "fixture", "copy", "k"), "source_system": F.lit("XERO"),
        "name_raw": F.concat_ws(" ", F.lit("Fixture"), "fixture", F.col("copy").cast("string"), F.nullif("suffix", F.lit(""))), "number": F.when(F.col("n").isNotNull(), F.pmod(F.xxhash64("fixture", "copy", "n"), F.lit(900_000_000)) + 50_000_000),
        "bare_number": F.lit(False), "payment_date": F.make_date(F.lit(shape.tax_year), F.col("month"), F.lit(15) + F.col("k")), "method": F.when(F.col("card"), "CREDIT_CARD").otherwise("CHECK"), "expense_class": F.lit("SERVICES"), "defect": F.lit(None).cast("string"),
    })
    return _finished(rows, shape)


def ledger(spark: SparkSession, shape: Shape = Shape(), copies: int = 25) -> DataFrame:
    """Background and planted cases."""
    return payments(spark, shape).unionByName(fixtures(spark, shape, copies))


def expected(spark: SparkSession, copies: int = 25) -> DataFrame:
    """The manifest of the planted cases: fixture, copies, vendors, the five sums (cents) and the reason of one copy."""
    return spark.createDataFrame([(case, copies, vendors, *sums, reason) for case, _, sums, vendors, reason in CASES], "fixture string, copies int, vendors int, gross_cents long, card_excluded_cents long, reversal_cents long, reportable_cents long, withholding_cents long, requirement_reason string")


def revised(lines: DataFrame, seed: int, changed: float = 0.01, removed: float = 0.005) -> DataFrame:
    """A later export of the same book: some amounts differ by a cent and some rows are gone, planted cases stay."""
    kept = F.col("fixture").isNotNull() | (fraction(seed, "removed", F.col("line_id")) >= removed)
    cents = F.when(F.col("fixture").isNull() & (fraction(seed, "changed", F.col("line_id")) < changed), F.col("amount_cents") + 1).otherwise(F.col("amount_cents"))
    return lines.filter(kept).withColumn("amount_cents", cents)
