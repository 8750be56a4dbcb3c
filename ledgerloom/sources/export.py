"""Accounting exports: a directory with manifest.json, clients.csv and payment files of several systems.

Headers differ by system and are mapped by alias; records are read as text with
their line numbers, parsed and judged by one ordered chain of gates, and split
into payments and rejections. Nothing is dropped without a reason.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..session import scratch, writing
from . import records

COLUMNS = ("source_system", "source_txn_id", "client_ref", "vendor_name", "vendor_tin", "vendor_tin_type", "payment_date", "amount", "currency", "payment_method", "entry_type", "reverses_source_txn_id", "backup_withholding", "expense_category", "memo")

# Header names by system.
ALIASES = {
    "QUICKBOOKS": {"payment_date": ("txn date", "date"), "vendor_name": ("vendor", "payee", "name"), "vendor_tin": ("vendor tax id", "tax id"), "amount": ("amount", "open balance"), "payment_method": ("payment method", "method"), "client_ref": ("customer", "client"), "source_txn_id": ("txn id", "num"), "memo": ("memo", "memo/description"), "expense_category": ("account",), "entry_type": ("transaction type",)},
    "XERO": {"payment_date": ("date", "payment date"), "vendor_name": ("contact name", "contact", "supplier"), "vendor_tin": ("tax number", "tax id number"), "amount": ("total", "amount"), "payment_method": ("payment type", "payment method"), "client_ref": ("tracking category", "client"), "source_txn_id": ("paymentid", "payment id"), "memo": ("reference", "description"), "expense_category": ("account code",), "entry_type": ("type",)},
    "SPREADSHEET": {"payment_date": ("date", "date paid", "paid"), "vendor_name": ("who", "paid to", "vendor", "company"), "vendor_tin": ("ein", "ein/ssn", "tin"), "amount": ("amount", "$", "total paid"), "payment_method": ("how paid", "method"), "client_ref": ("client", "job"), "memo": ("notes", "note", "for"), "expense_category": ("category",)},
    "CANONICAL": {},
}
BY_HEADER = {d: {h: c for c, hs in own.items() for h in hs} for d, own in ALIASES.items()}


def header_key(raw: str) -> str:
    return " ".join(raw.strip().lower().split())


def detect(headers: list[str], declared: str | None) -> str:
    """The system that knows most headers, if it knows three; else the declared one; else CANONICAL."""
    keys = [header_key(h) for h in headers]
    scores = {d: sum(k in own for k in keys) for d, own in BY_HEADER.items()}
    best = max(scores, key=lambda d: scores[d])  # the first of equals
    if scores[best] >= 3:
        return best
    named = (declared or "").strip().upper()
    return named if named in BY_HEADER else "CANONICAL"


def canonical_headers(headers: list[str], dialect: str) -> list[str]:
    """Canonical names in file order; a name's second occurrence gets a name that nothing reads."""
    seen, out = set(), []
    for i, h in enumerate(headers):
        k = header_key(h)
        name = BY_HEADER[dialect].get(k, k.replace(" ", "_").replace("-", "_"))
        out.append(f"_again_{i}" if name in seen else name)
        seen.add(name)
    return out


@dataclass(frozen=True)
class Manifest:
    tax_year: int
    revision: int
    client_refs: tuple[str, ...]
    covered_years: tuple[int, ...]
    files: tuple[tuple[str, str], ...]


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file


def read_manifest(spark: SparkSession, directory: str) -> Manifest:
    m = json.loads(read_text(spark, f"{directory}/manifest.json"))
    return Manifest(m["taxYear"], m.get("revision", 0), tuple(m["clientRefs"]), tuple(m.get("coveredTaxYears") or [m["taxYear"]]), tuple((f["name"], f["sourceSystem"]) for f in m["files"]))


def read_clients(spark: SparkSession, directory: str) -> DataFrame:
    raw = spark.read.csv(f"{directory}/clients.csv", header=True)
    c = raw.columns
    return raw.select(*[F.col(f"`{c[i]}`").alias(n) for i, n in ((0, "client_ref"), (1, "legal_name"), (3, "address"), (4, "city"), (5, "state"), (6, "postal_code")) if i < len(c)])


def read_payments(spark: SparkSession, path: str, declared: str | None) -> DataFrame:
    """file_name, line_no (the header is line 1), n_fields, n_headers, dialect, raw_line and the canonical columns as text.

    A quoted field may hold line breaks and any quote may be stray (see
    ``records``); a gzipped file (by suffix) is one split; a folder is one file in
    parts. A record with a cell of more than ``records.MOST_CHARS`` characters has
    ``n_fields`` -1, as no header has.
    """
    headers = _split_header(spark, records.first_line(spark, path))
    if len(headers) > records.MOST_COLUMNS:
        raise ValueError(f"{path}: {len(headers)} columns, more than {records.MOST_COLUMNS}")
    dialect = detect(headers, declared)
    names = canonical_headers(headers, dialect)
    body = records.read_records(spark, path).filter("line_no > 1 and trim(raw_line) <> ''").withColumn("_f", records.split_fields(F.col("raw_line")))
    too_long = (F.char_length("raw_line") > records.MOST_CHARS) & F.exists("_f", lambda c: F.char_length(c) > records.MOST_CHARS)
    picked = [F.get("_f", F.lit(names.index(c))).alias(c) if c in names else F.lit(None).cast("string").alias(c) for c in COLUMNS]
    return body.select(F.lit(path.rsplit("/", 1)[-1]).alias("file_name"), "line_no", F.when(too_long, -1).otherwise(F.size("_f")).alias("n_fields"), F.lit(len(names)).alias("n_headers"), F.lit(dialect).alias("dialect"), F.lit(declared).alias("declared"), "raw_line", *picked)


def _split_header(spark: SparkSession, line: str) -> list[str]:
    import csv

    return next(csv.reader([line]), [])


def by_dialect(make) -> Column:
    out = F.when(F.lit(False), None)
    for d in ALIASES:
        out = out.when(F.col("dialect") == d, make(d))
    return out


def judge(records: DataFrame, clients: DataFrame) -> DataFrame:
    """Typed columns and ``reject_code`` (null for good rows): the gates in their order, the first that fails names the row."""
    known = clients.select(F.trim("client_ref").alias("_known")).distinct()
    r = records.withColumn("client_ref", F.trim("client_ref")).join(known, F.col("client_ref") == F.col("_known"), "left")
    r = r.withColumns({"date_value": by_dialect(lambda d: S.parse_date(F.col("payment_date"), d)), "amount_value": S.parse_amount(F.col("amount")), "tin_state": S.tin_status(F.col("vendor_tin"))})
    r = r.withColumn("cents", S.exact_cents(F.col("amount_value")))
    r = S.normalize_names(r.withColumn("vendor_name", F.coalesce("vendor_name", F.lit(""))), "vendor_name", "vendor_name_norm")
    code = (
        F.when(F.col("n_fields") != F.col("n_headers"), "RAGGED_ROW")
        .when(S.blank(F.col("client_ref")), "MISSING_CLIENT_REF")
        .when(F.col("_known").isNull(), "UNKNOWN_CLIENT_REF")
        .when(~S.blank(F.col("currency")) & (F.upper(F.trim("currency")) != "USD"), "UNSUPPORTED_CURRENCY")
        .when(F.col("date_value").isNull(), "UNPARSEABLE_DATE")
        .when(F.col("amount_value").isNull(), "UNPARSEABLE_AMOUNT")
        .when(F.col("cents").isNull(), "SUB_CENT_AMOUNT")
        .when((F.col("vendor_name_norm") == "") & (F.col("tin_state") != "PRESENT"), "UNIDENTIFIABLE_VENDOR")
    )
    return r.withColumn("reject_code", code).drop("_known")


def normalize(judged: DataFrame, firm_id: int, key: bytes) -> DataFrame:
    """Good rows as typed payments: blind index, method, entry type, class, native or natural id, row hash (memo and line number are no part of it)."""
    g = judged.filter("reject_code is null").withColumn("firm_id", F.lit(firm_id))
    digits = F.when(F.col("tin_state") == "PRESENT", S.tin_digits(F.col("vendor_tin")))
    g = g.withColumns({
        "tin_bidx": S.tin_index(key, F.col("firm_id"), digits), "name_bidx": S.name_index(key, F.col("firm_id"), F.col("vendor_name_norm")), "tin_last4": F.substring(digits, -4, 4),
        "tin_raw_masked": F.when(F.col("tin_state") == "MALFORMED", S.tin_mask(F.col("vendor_tin"))),
        "withholding": S.withholding_cents(F.col("backup_withholding")), "method": S.payment_method(F.col("payment_method")), "class": S.expense_class(F.col("expense_category")), "entry": S.entry_type(F.col("entry_type"), F.col("cents")),
        "system": F.when(S.blank(F.col("source_system")), F.col("declared")).otherwise(F.trim("source_system")),
    })
    natural = ["client_ref", "vendor_name_norm", "tin_bidx", "date_value", "cents", "method", "entry", "withholding", "class"]
    nameless = S.blank(F.col("source_txn_id"))
    w = Window.partitionBy("file_name", *natural).orderBy("line_no")
    counted = g.filter(nameless).withColumn("txn_id", S.natural_id([F.col(c) for c in natural], F.row_number().over(w)))  # only these are moved and sorted
    g = g.filter(~nameless).withColumn("txn_id", F.trim("source_txn_id")).unionByName(counted)
    reverses = F.coalesce(F.trim("reverses_source_txn_id"), F.lit(""))
    digest = S.fields_hash(F.col("client_ref"), F.col("system"), F.col("txn_id"), F.col("vendor_name"), F.col("vendor_name_norm"), F.col("tin_bidx"), F.col("tin_state"), F.col("date_value"), F.col("cents"), F.col("withholding"), F.col("method"), S.is_card_or_tpso(F.col("method")), F.col("entry"), reverses, F.col("class"))
    return g.select(
        "firm_id", F.col("client_ref").alias("client_id"), F.col("system").alias("source_system"), F.col("txn_id").alias("source_txn_id"), F.col("vendor_name").alias("name_raw"), F.col("vendor_name_norm").alias("name_norm"),
        "tin_bidx", "name_bidx", F.col("tin_state").alias("tin_status"), "tin_last4", "tin_raw_masked", F.col("date_value").alias("payment_date"), F.year("date_value").alias("tax_year"), F.col("cents").alias("amount_cents"),
        F.col("withholding").alias("withholding_cents"), "method", S.is_card_or_tpso(F.col("method")).alias("is_card"), F.col("entry").alias("entry_type"), F.when(reverses != "", reverses).alias("reverses_source_txn_id"), F.col("class").alias("expense_class"),
        F.coalesce("memo", F.lit("")).alias("memo"), digest.alias("row_hash"), "file_name", "line_no",
    )


def rejections(judged: DataFrame, run_id: int) -> DataFrame:
    return judged.filter("reject_code is not null").select(F.lit(run_id).alias("run_id"), "file_name", "line_no", F.col("reject_code").alias("reason_code"), S.redacted_line(F.col("raw_line")).alias("raw_line_redacted"))


class TooManyRejections(RuntimeError):
    """Of ``import_export`` it carries the run's ``rejections``."""

    rejections: DataFrame | None = None


def guard(judged: DataFrame, most: float = 0.05) -> tuple[int, int]:
    """(rows, rejected); raises where more than ``most`` of the rows are rejected, which points at the file and not at rows."""
    n, bad = judged.agg(F.count(F.lit(1)), F.count("reject_code")).first()
    if n and bad / n > most:
        raise TooManyRejections(f"{bad} of {n} rows rejected")
    return n, bad


@dataclass
class ImportResult:
    payments: DataFrame
    rejections: DataFrame
    changes: DataFrame
    snapshot: DataFrame
    dirty: DataFrame
    rows_read: int
    rows_rejected: int


SNAPSHOT = ["firm_id", "client_id", "source_system", "source_txn_id", "name_raw", "name_norm", "tin_bidx", "name_bidx", "tin_status", "tin_last4", "payment_date", "tax_year", "amount_cents", "withholding_cents", "method", "is_card", "entry_type", "reverses_source_txn_id", "expense_class", "memo", "row_hash"]


def import_export(spark: SparkSession, directory: str, firm_id: int, key: bytes, old: DataFrame | None = None, run_id: int = 1, most_rejected: float = 0.05) -> ImportResult:
    """One import: read, judge, guard, dedupe (the last copy stays), merge into ``old``, tombstone what the declared scope no longer has."""
    from functools import reduce

    from ..operators import merge

    m = read_manifest(spark, directory)
    clients = read_clients(spark, directory)
    raw = reduce(DataFrame.unionByName, [read_payments(spark, f"{directory}/{name}", system) for name, system in m.files])
    path = scratch(spark, "judged")
    with writing(spark):
        judge(raw, clients).write.parquet(path)  # read several times below
    judged = spark.read.parquet(path)
    try:
        n, bad = guard(judged, most_rejected)
    except TooManyRejections as e:
        e.rejections = rejections(judged, run_id)
        raise
    rows = merge.keep_last(normalize(judged, firm_id, key), merge.KEY, [F.col("file_name"), F.col("line_no")])
    new = rows.select(*SNAPSHOT)
    before = old if old is not None else new.limit(0).withColumn("deleted", F.lit(False))
    scope = F.col("client_id").isin(*m.client_refs) & F.col("source_system").isin(*sorted({s for _, s in m.files})) & F.col("o_tax_year").isin(*m.covered_years)
    changes = merge.diff(before, new, scope)
    return ImportResult(rows, rejections(judged, run_id), changes, merge.merged(changes, SNAPSHOT), merge.dirty_units(changes), n, bad)


def write_csv(df: DataFrame, path: str, order: list[str]) -> str:
    """One deterministic CSV: fixed order, LF, header (for exports of modest size; one task writes). Returns the SHA-256 of its bytes."""
    df.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).option("lineSep", "\n").option("escape", '"').csv(path)
    return df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).select(F.sha2("content", 256)).first()[0]
