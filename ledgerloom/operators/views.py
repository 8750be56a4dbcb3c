"""Derived status views: every view is a function of snapshots, or of counts kept from them (``upkeep``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tax years that a status view lists at most.
MOST_YEARS = 100


def _n(*states: str):
    return F.count(F.when(F.col("state").isin(*states), 1))


CLIENT = ["firm_id", "client_id"]
COUNTS = {"n_accepted": ("ACCEPTED",), "n_rejected": ("REJECTED",), "n_blocked": ("BLOCKED",), "n_awaiting": ("SUBMITTED_UNACKNOWLEDGED",), "n_ready": ("DRAFT", "READY_TO_TRANSMIT"), "n_batched": ("BATCHED",)}


def status_counts(filings: DataFrame, sign: Column | None = None) -> DataFrame:
    """Counts of each client's filings of a year by state: sums, so that those of parts, or of changes with a ``sign``, add up."""
    one = F.lit(1) if sign is None else sign
    total = lambda when, value: F.coalesce(F.sum(F.when(when, value * one)), F.lit(0)).cast("long")
    return filings.groupBy(*CLIENT, "tax_year").agg(
        F.sum(one).cast("long").alias("n_total"), *[total(F.col("state").isin(*states), F.lit(1)).alias(c) for c, states in COUNTS.items()], total(F.col("state") == "ACCEPTED", F.col("amount_cents")).alias("accepted_cents")
    )


def attention_counts(attention: DataFrame) -> DataFrame:
    """Open items by client and severity."""
    return attention.filter("resolved_at is null").groupBy(*CLIENT, "severity").agg(F.count(F.lit(1)).alias("n"))


def client_status(clients: DataFrame, years: DataFrame, filings: DataFrame, attention: DataFrame) -> DataFrame:
    """One row per client and known year (a spine: no client can vanish), with counts and a status, first match wins."""
    return status_of(clients, years, status_counts(filings), attention_counts(attention))


def status_of(clients: DataFrame, years: DataFrame, counts: DataFrame, open_: DataFrame) -> DataFrame:
    """The status view from kept counts (``status_counts``, ``attention_counts``): what it reads follows the number of clients, not of filings."""
    listed = years.agg(F.collect_set("tax_year").alias("_years"))  # one row, whose size is checked
    checked = F.when(F.size("_years") <= MOST_YEARS, F.col("_years")).otherwise(F.raise_error(F.lit(f"more than {MOST_YEARS} tax years")).cast("array<int>"))
    worst = open_.groupBy(*CLIENT).agg(F.sum("n").cast("long").alias("n_attention"), F.min("severity").alias("worst_severity"))
    spine = clients.join(F.broadcast(listed)).select(*clients.columns, F.explode(checked).alias("tax_year"))
    j = spine.join(counts, [*CLIENT, "tax_year"], "left").join(worst, CLIENT, "left").fillna(0, ["n_total", *COUNTS, "accepted_cents", "n_attention"])
    status = (
        F.when((F.col("n_rejected") > 0) | (F.col("n_blocked") > 0) | (F.col("n_attention") > 0), "NEEDS_ATTENTION")
        .when(F.col("n_total") == 0, "NOTHING_TO_FILE")
        .when(F.col("n_accepted") == F.col("n_total"), "FULLY_FILED")
        .when(F.col("n_accepted") > 0, "PARTIALLY_FILED")
        .when(F.col("n_awaiting") + F.col("n_batched") > 0, "AWAITING_IRS")
        .otherwise("READY_TO_FILE")
    )
    return j.withColumn("status", status)


def ranked(status: DataFrame) -> DataFrame:
    """Clients that need someone first, then by what is open, then by id."""
    rank = F.when(F.col("status") == "NEEDS_ATTENTION", 0).when(F.col("status") == "READY_TO_FILE", 1).when(F.col("status") == "AWAITING_IRS", 2).when(F.col("status") == "PARTIALLY_FILED", 3).when(F.col("status") == "FULLY_FILED", 4).otherwise(5)
    return status.orderBy(rank, (F.col("n_rejected") + F.col("n_blocked")).desc(), "client_id", "tax_year")


def tiles(filings: DataFrame) -> DataFrame:
    return filings.agg(F.count(F.lit(1)).alias("n_total"), _n("ACCEPTED").alias("n_accepted"), _n("BLOCKED", "REJECTED").alias("n_human"), F.coalesce(F.sum(F.when(F.col("state") == "ACCEPTED", F.col("amount_cents"))), F.lit(0)).alias("accepted_cents"))


def known_years(runs: DataFrame, filings: DataFrame) -> DataFrame:
    return runs.select("tax_year").union(filings.select("tax_year")).distinct()


def open_exceptions(attention: DataFrame, raised: DataFrame, filings: DataFrame) -> DataFrame:
    """Attention, and determination exceptions not yet covered by a paired open item, in one list.

    A code without a pair maps to null, which equals nothing, so such rows always show.
    """
    open_ = attention.filter("resolved_at is null")
    a = open_.select("severity", F.col("type").alias("code"), "entity_type", "entity_id", *CLIENT, F.concat_ws(":", F.lit("ATTENTION"), "entity_type", "entity_id", "type").alias("dedupe_key"))
    covered = open_.filter("entity_type = 'FILING'").join(filings.select("firm_id", F.col("filing_id").alias("entity_id"), "vendor_key", "tax_year"), ["firm_id", "entity_id"]).select(*CLIENT, "vendor_key", "tax_year", F.col("type").alias("pair"))
    pair = F.when(F.col("code").isin("MISSING_TIN", "MALFORMED_TIN"), "VENDOR_MISSING_TIN")
    d = raised.withColumn("pair", pair).join(covered, [*CLIENT, "vendor_key", "tax_year", "pair"], "left_anti")
    d = d.select(F.when(F.col("severity") == "BLOCKING", 5).otherwise(6).alias("severity"), "code", F.lit("VENDOR").alias("entity_type"), F.col("vendor_key").alias("entity_id"), *CLIENT, F.concat_ws(":", F.lit("DETERMINATION"), "client_id", "vendor_key", "code").alias("dedupe_key"))
    return a.unionByName(d)


def rejected_imports(rejections: DataFrame) -> DataFrame:
    """The latest run's rejected rows as exceptions, one for each file and reason."""
    kind = F.concat_ws(":", "file_name", "reason_code")
    rows = latest_run(rejections).select("file_name", "reason_code").distinct()
    return rows.select(F.lit(7).alias("severity"), F.lit("IMPORT_ROWS_REJECTED").alias("code"), F.lit("IMPORT").alias("entity_type"), kind.alias("entity_id"), *[F.lit(None).cast("int").alias(c) for c in CLIENT], F.concat_ws(":", F.lit("IMPORT"), "file_name", "reason_code").alias("dedupe_key"))


def exception_view(attention: DataFrame, raised: DataFrame, filings: DataFrame, rejections: DataFrame) -> DataFrame:
    """Open exceptions and rejected import rows in one list."""
    return open_exceptions(attention, raised, filings).unionByName(rejected_imports(rejections))


def rejection_summary(rejections: DataFrame, sample: int = 5) -> DataFrame:
    """Rejections of the latest completed run by file and reason, with the first line numbers."""
    latest = rejections.agg(F.max("run_id").alias("run_id"))
    own = rejections.join(F.broadcast(latest), "run_id")
    kind = ["file_name", "reason_code"]
    counts = own.groupBy(*kind).agg(F.count(F.lit(1)).alias("n_rows"))
    first = own.select(*kind, "line_no", F.row_number().over(Window.partitionBy(*kind).orderBy("line_no")).alias("_n")).filter(F.col("_n") <= sample)  # each task passes on its first ones only
    lines = first.groupBy(*kind).agg(F.array_join(F.array_sort(F.collect_list("line_no")), ",").alias("sample_lines"))
    return counts.join(lines, kind)


def exception_groups(view: DataFrame) -> DataFrame:
    return view.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n")).orderBy("severity", F.col("n").desc(), "code")


def urgent(view: DataFrame, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(the first ``most`` rows by severity and key, a row that tells the full count and whether the list is cut)."""
    return view.orderBy("severity", "dedupe_key").limit(most), view.agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) > most).alias("truncated"))


def open_by_type(attention: DataFrame) -> DataFrame:
    return attention.filter("resolved_at is null").groupBy("severity", "type").agg(F.count(F.lit(1)).alias("n")).orderBy("severity", "type")


def outstanding(work: DataFrame) -> DataFrame:
    return work.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("filing_count").alias("filings"), F.count(F.when(F.col("needs_reconcile"), 1)).alias("to_reconcile"), F.min("next_action_us").alias("next_action_us"))


# -- pages: relations that a reader opens one of ------------------------------


def latest_run(rejections: DataFrame) -> DataFrame:
    """The rows of the last run."""
    return rejections.join(F.broadcast(rejections.agg(F.max("run_id").alias("run_id"))), "run_id")


def lookup(rows: DataFrame, **values) -> DataFrame:
    """Rows whose columns hold one of the given values (a list) or the given value."""
    for column, value in values.items():
        rows = rows.filter(F.col(column).isin(*value) if isinstance(value, (list, tuple)) else F.col(column) == value)
    return rows


def client_detail(decisions: DataFrame, filings: DataFrame, client_id: int) -> DataFrame:
    """A client's vendors with what was decided and the state of their filing, the largest amount first."""
    key = [*CLIENT, "vendor_key", "tax_year"]
    own = decisions.filter(F.col("client_id") == client_id).join(filings.select(*key, "filing_id", F.col("state").alias("filing_state")), key, "left")
    return own.orderBy(F.col("reportable_cents").desc(), "vendor_key").select("vendor_key", "display_name", "reportable_cents", "filing_id", "filing_state")


def payment_evidence(classified: DataFrame, client_id: int) -> DataFrame:
    """A client's payments by vendor, in order, with why each counted or did not."""
    own = classified.filter(F.col("client_id") == client_id)
    return own.orderBy("vendor_key", "payment_date", "line_id").select("vendor_key", "payment_date", "line_id", "amount_cents", "disposition", F.col("disposition").startswith("COUNTED").alias("counted"))


def open_attention(attention: DataFrame, filings: DataFrame) -> DataFrame:
    """Open items with the recipient's name, most urgent first."""
    named = filings.select("firm_id", F.col("filing_id").alias("entity_id"), "recipient_name")
    return attention.filter("resolved_at is null").join(named, ["firm_id", "entity_id"]).orderBy("severity", "entity_id").select("severity", "type", "entity_id", "recipient_name")


def batch_list(work: DataFrame) -> DataFrame:
    return work.orderBy("firm_id", "client_id", "batch_id").select("firm_id", "client_id", "batch_id", "state")


def resolve_attention(attention: DataFrame, done: DataFrame) -> DataFrame:
    """Attention after items named in ``done`` (firm_id, entity_id, resolved_at) are resolved; what was resolved before keeps its time."""
    now = done.select("firm_id", "entity_id", F.col("resolved_at").alias("_now"))
    return attention.join(now, ["firm_id", "entity_id"], "left").withColumn("resolved_at", F.coalesce("resolved_at", "_now")).drop("_now")


def acknowledge_exceptions(raised: DataFrame, notes: DataFrame) -> DataFrame:
    """Exceptions with a reader's note; one that was seen stays in the list."""
    return raised.join(notes, [*CLIENT, "vendor_key", "code"], "left")
