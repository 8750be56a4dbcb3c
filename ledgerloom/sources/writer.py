"""Renders a ledger as an export directory: manifest, clients, one payment file per system in its own headers and spellings.

A payment file is a folder of parts in the order of their names, one a task;
manifest and clients are single small files.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import writing
from .records import cell

HEADERS = {
    "QUICKBOOKS": [("Txn Date", "date_text"), ("Vendor", "name_raw"), ("Tax ID", "tin_text"), ("Amount", "amount_text"), ("Payment Method", "method_text"), ("Customer", "client_text"), ("Txn ID", "line_id"), ("Memo", "memo_text"), ("Account", "class_text"), ("Transaction Type", "entry_text"), ("Currency", "currency_text"), ("Backup Withholding", "held_text")],
    "XERO": [("Payment Date", "date_text"), ("Contact Name", "name_raw"), ("Tax Number", "tin_text"), ("Total", "amount_text"), ("Payment Type", "method_text"), ("Tracking Category", "client_text"), ("PaymentID", "line_id"), ("Reference", "memo_text"), ("Account Code", "class_text"), ("Type", "entry_text"), ("Currency", "currency_text"), ("Backup Withholding", "held_text")],
    "SPREADSHEET": [("Date Paid", "date_text"), ("Who", "name_raw"), ("EIN/SSN", "tin_text"), ("$", "amount_text"), ("How Paid", "method_text"), ("Client", "client_text"), ("Notes", "memo_text"), ("Category", "class_text"), ("Currency", "currency_text"), ("Backup Withholding", "held_text")],
}


def money_text(system: str, cents: Column) -> Column:
    plain = F.format_number(F.abs(cents).cast("decimal(20,2)") / 100, 2)
    if system == "XERO":
        return F.concat(F.when(cents < 0, "-").otherwise(""), F.replace(plain, F.lit(","), F.lit("")))
    if system == "SPREADSHEET":
        return F.when(cents < 0, F.concat(F.lit("($"), plain, F.lit(")"))).otherwise(F.concat(F.lit("$"), plain))
    return F.concat(F.when(cents < 0, "-").otherwise(""), plain)


DATES = {"QUICKBOOKS": "MM/dd/yyyy", "XERO": "yyyy/MM/dd", "SPREADSHEET": "M/d/yyyy"}


def file_name(system: str) -> str:
    return f"payments-{system.lower()}.csv"


def _by_system(lines: DataFrame, line: Column, directory: str, **options) -> None:
    """The payment files of all systems by one job: ledger rows are dealt by system and id, and ``line`` renders them where they have come to lie, so what finds the ranges renders nothing."""
    spark, systems = lines.sparkSession, list(HEADERS)
    number = F.when(F.lit(False), 0)  # a number: a text would be sorted anew, without the ids, by the writer
    for i, system in enumerate(systems):
        number = number.when(F.col("source_system") == system, i)
    headers = spark.createDataFrame([(s, "", ",".join(h for h, _ in HEADERS[s])) for s in systems], "source_system string, line_id string, _header string")  # "" comes before any id
    rows = headers.unionByName(lines.withColumn("line_id", F.col("line_id").cast("string")), allowMissingColumns=True).withColumn("_system", number).filter("_system is not null")
    dealt = rows.repartitionByRange("_system", "line_id").select("_system", "line_id", line.alias("value")).sortWithinPartitions("_system", "line_id")
    with writing(spark):
        dealt.select("_system", "value").write.partitionBy("_system").options(**options).text(f"{directory}/_payments")
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path
    fs = path(directory).getFileSystem(sc._jsc.hadoopConfiguration())
    for i, system in enumerate(systems):
        fs.rename(path(f"{directory}/_payments/_system={i}"), path(f"{directory}/{file_name(system)}"))
    fs.delete(path(f"{directory}/_payments"), True)


def _single(df: DataFrame, path: str, **options) -> None:
    df.coalesce(1).write.options(escape='"', **options).csv(path)


def _json(spark, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def write_export(lines: DataFrame, directory: str, tax_year: int, years: list[int], revision: int = 0, gzip: bool = False, fixtures: DataFrame | None = None) -> None:
    """``lines``: a ledger with line_id, names, dates and cents; ``defect`` (null or a kind) spoils a row on purpose; ``memo_text`` is its memo where the column is there.

    ``fixtures``, the manifest of planted cases, is written beside the export's own manifest.
    """
    spark = lines.sparkSession
    digits = F.col("tin_digits") if "tin_digits" in lines.columns else F.concat(F.lit("1"), F.lpad(F.col("suppkey").cast("string"), 8, "0"))
    bare = F.col("bare_number") if "bare_number" in lines.columns else F.lit(False)
    number = F.when(bare, digits).otherwise(F.concat(F.substring(digits, 1, 2), F.lit("-"), F.substring(digits, 3, 7)))
    spoiled = lambda kind, bad, good: F.when(F.col("defect") == kind, F.lit(bad)).otherwise(good)
    line = F.col("_header")
    for system, headers in HEADERS.items():
        texts = {
            "date_text": spoiled("date", "TBD", F.date_format("payment_date", DATES[system])), "amount_text": spoiled("amount", "N/A", spoiled("subcent", "12.345", money_text(system, F.col("amount_cents")))),
            "client_text": spoiled("client", "C-999999", spoiled("noclient", "", F.concat(F.lit("C-"), F.col("client_id").cast("string")))),
            "held_text": F.when(F.col("withholding_cents") > 0, money_text(system, F.col("withholding_cents"))).otherwise(""),
            "currency_text": spoiled("currency", "EUR", F.lit("USD")), "name_raw": spoiled("vendor", "", F.col("name_raw")), "line_id": F.col("line_id"),
            "tin_text": F.when(F.col("defect") == "vendor", "").when(F.col("tin_status") == "PRESENT", number).when(F.col("tin_status") == "MALFORMED", "12-34567").otherwise(""),
            "method_text": F.when(F.col("method") == "CREDIT_CARD", "Credit_Card").when(F.col("method") == "TPSO", "PayPal").when(F.col("method") == "CHECK", F.concat(F.lit("Check #"), F.col("linenumber").cast("string"))).when(F.col("method").isin("WIRE", "CASH"), F.initcap("method")).when(F.col("method") == "UNKNOWN", "barter").otherwise("e-transfer"),
            "memo_text": F.col("memo_text") if "memo_text" in lines.columns else F.lit("memo, with comma"), "class_text": F.when(F.col("expense_class") == "SERVICES", "").otherwise("goods"), "entry_text": F.when(F.col("entry_type") == "VOID", "voided").otherwise(""),
        }
        text = F.concat(F.concat_ws(",", *[cell(texts[c]) for _, c in headers]), spoiled("ragged", ",one more", F.lit("")))
        line = F.coalesce(line, F.when(F.col("source_system") == system, text))
    _by_system(lines, line, directory, **({"compression": "gzip"} if gzip else {}))
    files = [{"name": file_name(system), "sourceSystem": system} for system in HEADERS]
    refs = sorted(f"C-{r.client_id}" for r in lines.select("client_id").distinct().collect())  # the declared clients of one book
    _single(spark.createDataFrame([(r, r, "", "a", "b", "CA", "1") for r in refs], "client_ref string, legal_name string, ein string, address string, city string, state string, postal_code string"), f"{directory}/clients.csv", header=True)
    _json(spark, {"taxYear": tax_year, "revision": revision, "clientRefs": refs, "coveredTaxYears": years, "files": files}, f"{directory}/manifest.json")
    if fixtures is not None:
        _json(spark, {"cases": [r.asDict() for r in fixtures.orderBy("fixture").collect()]}, f"{directory}/fixtures.json")  # a row a case
