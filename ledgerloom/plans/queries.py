"""One query per operator, with its SQL for the oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit
from ..operators import determine as D
from ..operators import filings as B
from ..operators import merge as M
from ..operators import runs as R
from ..operators import upkeep as U
from ..operators import views as V
from ..reasons import REASONS, reason_codes
from ..rules import RuleSet
from ..session import SHARED, FirmSession, catalog_facts, drop_scratch, scratch
from ..sources import export, generator, records, writer
from ..sources.testdata import table
from ..store import Store
from ..streaming import admission
from ..streaming.changes import windowed_calls
from ..streaming.sessions import label_late, sessions
from .book import BATCH_SIZE, BOOK_SQL, NOW_US, RULES, SCOPE, SNAP, Book, digit

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
HOUR, LIMIT = 3_600_000_000, 2
AS_TEXT = ("n_tins", "valid_to", "resolved_at", "lease_until_us", "worst_severity", "worst")


def _dates_as_text(df: DataFrame) -> DataFrame:
    """Dates, and whole numbers that may be null, as text, which every engine compares alike."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date" or c in AS_TEXT and kind in ("int", "bigint")})


def add(name: str, make: Callable[[Book], DataFrame], sql: str | None = None, book: bool = True) -> None:
    QUERIES[name] = lambda spark, sf_dir: _dates_as_text(make(Book(spark, sf_dir)))
    if sql:
        ORACLES[name] = (BOOK_SQL if book else "") + sql


def fixture(name: str, schema: str, rows: list[tuple], make: Callable[[DataFrame], DataFrame], expected: str) -> None:
    """A row function on given values; the oracle states what must come out."""
    QUERIES[name] = lambda spark, _: make(spark.createDataFrame(rows, schema))
    ORACLES[name] = expected


# -- determination ------------------------------------------------------------

DECIDED = ["firm_id", "client_id", "vendor_key", "display_name", "tin_status", "identity_source", "gross_cents", "card_excluded_cents", "reversal_cents", "non_services_cents", "out_of_year_cents", "reportable_cents", "withholding_cents", "counted_count", "total_count", "form_required", "requirement_reason", "transmit_blocked"]
add("flagship_vendor_decisions", lambda b: b.decided.select(*DECIDED), f"SELECT {', '.join(DECIDED)} FROM decided")
add("flt1_live_rows", lambda b: b.live.groupBy("firm_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("cents")), "SELECT firm_id, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents FROM live GROUP BY firm_id")
add("src9_ledger_scan", lambda b: b.ledger.select("firm_id", "client_id", "line_id", "source_system", "payment_date", "tax_year", "amount_cents", "method", "deleted"), "SELECT firm_id, client_id, line_id, source_system, CAST(payment_date AS VARCHAR) AS payment_date, tax_year, amount_cents, method, deleted FROM ledger")
add("prj1_disposition", lambda b: b.classified.select("line_id", "disposition", "counted_cents"), "SELECT line_id, disposition, counted_cents FROM classified")
add("prj2_counted_cents", lambda b: b.classified.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"), F.sum("counted_cents").alias("cents")), "SELECT disposition, count(*) AS n, CAST(sum(counted_cents) AS BIGINT) AS cents FROM classified GROUP BY disposition")
add("prj3_vendor_key", lambda b: b.classified.select("line_id", "vendor_key"), "SELECT line_id, vendor_key FROM classified")
add("prj4_identity_source", lambda b: b.classified.groupBy("firm_id", "identity_source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vendor_key").alias("vendors")), "SELECT firm_id, identity_source, count(*) AS n, count(DISTINCT vendor_key) AS vendors FROM classified GROUP BY firm_id, identity_source")
add("prj5_decision", lambda b: b.decided.groupBy("requirement_reason", "form_required", "transmit_blocked").agg(F.count(F.lit(1)).alias("n")), "SELECT requirement_reason, form_required, transmit_blocked, count(*) AS n FROM decided GROUP BY ALL")
add("ag1_name_tin_cardinality", lambda b: D.name_identities(b.live, RULES), "SELECT firm_id, client_id, name_norm, CAST(n_tins AS VARCHAR) AS n_tins, only_tin FROM names")
add("ag2_vendor_decomposition", lambda b: b.decided.select("firm_id", "client_id", "vendor_key", "gross_cents", "card_excluded_cents", "reversal_cents", "non_services_cents", "out_of_year_cents", "reportable_cents", "withholding_cents"), "SELECT firm_id, client_id, vendor_key, gross_cents, card_excluded_cents, reversal_cents, non_services_cents, out_of_year_cents, reportable_cents, withholding_cents FROM decomposed")
add("ag3_any_tin_problem", lambda b: b.decided.select("firm_id", "client_id", "vendor_key", "any_tin_problem"), "SELECT firm_id, client_id, vendor_key, any_tin_problem FROM decomposed")
add("ag4_ag5_representatives", lambda b: b.decided.select("firm_id", "client_id", "vendor_key", "display_name", "tin_bidx", "tin_last4", "tin_status", "identity_source"), "SELECT firm_id, client_id, vendor_key, display_name, tin_bidx, tin_last4, tin_status, identity_source FROM decomposed")
add("jn1_jn8_resolved_lines", lambda b: b.classified.select("line_id", "n_tins", "only_tin"), "SELECT line_id, CAST(n_tins AS VARCHAR) AS n_tins, only_tin FROM resolved")
add("set2_exceptions", lambda b: D.exceptions(b.decided).select("firm_id", "client_id", "vendor_key", "code", "severity"), "SELECT firm_id, client_id, vendor_key, code, severity FROM raised")
add("jsn1_exception_details", lambda b: D.exceptions(b.decided).select("firm_id", "client_id", "vendor_key", "code", "detail"), """SELECT firm_id, client_id, vendor_key, code, '{"displayName":"' || display_name || '","reportableCents":' || reportable_cents || '}' AS detail FROM raised""")

REASON_SQL = ", ".join("('{}', '{}', '{}')".format(*(x.replace("'", "''") for x in row)) for row in REASONS)
add("src10_reason_codes", lambda b: reason_codes(b.spark), f"SELECT * FROM (VALUES {REASON_SQL}) v(code, category, human_text)", book=False)
add("jn3_jn12_explanations", lambda b: D.explanations(b.classified, reason_codes(b.spark)), f"SELECT firm_id, client_id, vendor_key, line_id, identity_source, disposition, counted_cents, human_text FROM classified LEFT JOIN (VALUES {REASON_SQL}) v(code, category, human_text) ON disposition = code")
add("golden_planted_difference", lambda b: D.unreconciled(b.classified, b.decisions.withColumn("reportable_cents", F.col("reportable_cents") + F.when(F.col("client_id") % 7 == 0, 1).otherwise(0))), "SELECT firm_id, client_id, vendor_key, reportable_cents + 1 AS reportable_cents, reportable_cents AS explained FROM decided WHERE client_id % 7 = 0")
add("golden_explained_equals_total", lambda b: D.unreconciled(b.classified, b.decided), "SELECT firm_id, client_id, vendor_key, reportable_cents, reportable_cents AS explained FROM decided WHERE false")


def _incremental(b: Book) -> DataFrame:
    dirty = b.dirty.filter("client_id % 3 = 0")
    parts = U.parts_of(U.cut(dirty.filter(F.col("tax_year") == RULES.tax_year)))
    others = [p for p in b.state.parts("decisions") if p not in parts]
    again = D.incremental(b.state.read("snapshot", parts), b.stored_aliases, RULES, dirty, b.state.read("decisions", parts).drop("bucket"))
    return b.state.read("decisions", others).drop("bucket").unionByName(again).select(*DECIDED)


add("flt4_state2_incremental_determination", _incremental, f"SELECT {', '.join(DECIDED)} FROM decided")
add("state2_write_back", lambda b: b.imported.read("decisions").select(*DECIDED), f"SELECT {', '.join(DECIDED)} FROM decided")


def _nothing_dirty(b: Book) -> DataFrame:
    rewritten = U.refresh_decisions(b.state, b.stored_aliases, RULES)
    return b.state.read("decisions").groupBy("firm_id").agg(F.count(F.lit(1)).alias("vendors"), F.sum("reportable_cents").alias("reportable_cents")).withColumn("parts_rewritten", F.lit(len(rewritten)))


add("flt4_nothing_dirty", _nothing_dirty, "SELECT firm_id, count(*) AS vendors, CAST(sum(reportable_cents) AS BIGINT) AS reportable_cents, 0 AS parts_rewritten FROM decided GROUP BY firm_id")
add("state_ruleset_hash", lambda b: b.spark.createDataFrame([(RULES.version,)], "ruleset string"), "SELECT substr(sha256('taxYear=1998;thresholdCents=6000000;nameNorm=1'), 1, 16) AS ruleset", book=False)

# -- merge family -------------------------------------------------------------


def _changes(b: Book) -> DataFrame:
    return b.changes


add("dml1_idempotent_merge", lambda b: _changes(b).select("firm_id", "client_id", "source_txn_id", "change"), "SELECT firm_id, client_id, source_txn_id, change FROM changes")
add("dml1_change_counts", lambda b: M.change_counts(_changes(b)), "SELECT change, count(*) AS n FROM changes GROUP BY change")
add("dml1_new_snapshot", lambda b: M.merged(_changes(b), SNAP), """SELECT firm_id, client_id, source_system, source_txn_id, CASE WHEN n_row_hash IS NOT NULL THEN n_tax_year ELSE o_tax_year END AS tax_year, CASE WHEN n_row_hash IS NOT NULL THEN n_amount_cents ELSE o_amount_cents END AS amount_cents,
 CASE WHEN n_row_hash IS NOT NULL THEN n_name_norm ELSE o_name_norm END AS name_norm, coalesce(n_row_hash, o_row_hash) AS row_hash, CASE change WHEN 'tombstoned' THEN true WHEN 'untouched' THEN o_deleted ELSE false END AS deleted FROM changes""")
add("dml2_keep_last", lambda b: M.keep_last(b.ledger.select("firm_id", "client_id", "suppkey", "payment_date", "line_id", "amount_cents"), ["firm_id", "client_id", "suppkey"], [F.col("payment_date"), F.col("line_id")]), "SELECT firm_id, client_id, suppkey, CAST(payment_date AS VARCHAR) AS payment_date, line_id, amount_cents FROM ledger l QUALIFY row_number() OVER (PARTITION BY firm_id, client_id, suppkey ORDER BY l.payment_date DESC, line_id DESC) = 1")


def _vendor_upsert(b: Book) -> DataFrame:
    old = M.vendors(b.live.filter("tax_year <= 1996"))
    new = M.vendors(b.live.filter("tax_year >= 1997"))
    return M.upsert_coalesce(old, new, ["firm_id", "client_id", "natural_key"], ["tin_last4"], ["name_raw", "tin_status"])


VENDOR_SQL = """, keyed AS (SELECT *, coalesce('TIN:' || tin_bidx, 'NAME:' || name_norm) AS natural_key FROM live),
v_old AS (SELECT * FROM keyed WHERE tax_year <= 1996 QUALIFY row_number() OVER (PARTITION BY firm_id, client_id, natural_key ORDER BY tin_bidx IS NULL, payment_date DESC, line_id) = 1),
v_new AS (SELECT * FROM keyed WHERE tax_year >= 1997 QUALIFY row_number() OVER (PARTITION BY firm_id, client_id, natural_key ORDER BY tin_bidx IS NULL, payment_date DESC, line_id) = 1)
"""
add("dml3_vendor_upsert", _vendor_upsert, VENDOR_SQL + "SELECT coalesce(n.firm_id, o.firm_id) AS firm_id, coalesce(n.client_id, o.client_id) AS client_id, coalesce(n.natural_key, o.natural_key) AS natural_key, coalesce(n.tin_last4, o.tin_last4) AS tin_last4, CASE WHEN n.natural_key IS NOT NULL THEN n.name_raw ELSE o.name_raw END AS name_raw, CASE WHEN n.natural_key IS NOT NULL THEN n.tin_status ELSE o.tin_status END AS tin_status FROM v_old o FULL OUTER JOIN v_new n ON o.firm_id = n.firm_id AND o.client_id = n.client_id AND o.natural_key = n.natural_key")
add("ag19_distinct_on_vendor", lambda b: M.vendors(b.live).select("firm_id", "client_id", "natural_key", "name_raw", "tin_last4", "payment_date"), VENDOR_SQL + "SELECT firm_id, client_id, natural_key, name_raw, tin_last4, CAST(payment_date AS VARCHAR) AS payment_date FROM keyed k QUALIFY row_number() OVER (PARTITION BY firm_id, client_id, natural_key ORDER BY tin_bidx IS NULL, k.payment_date DESC, line_id) = 1")
add("dml4_client_upsert", lambda b: M.upsert_coalesce(table(b.spark, b.sf_dir, "customer").filter("c_custkey % 3 <> 0").select("c_custkey", "c_name", F.col("c_mktsegment").alias("segment")), table(b.spark, b.sf_dir, "customer").filter("c_custkey % 3 <> 1").select("c_custkey", F.lower("c_name").alias("c_name"), F.lit(None).cast("string").alias("segment")), ["c_custkey"], ["segment"], ["c_name"]),
    "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment END AS segment, CASE WHEN c_custkey % 3 <> 1 THEN lower(c_name) ELSE c_name END AS c_name FROM customer", book=False)
add("dml5_jn17_tombstones", lambda b: _changes(b).filter("change = 'tombstoned'").select("firm_id", "client_id", "source_txn_id"), "SELECT o.firm_id, o.client_id, o.source_txn_id FROM old_snapshot o WHERE NOT deleted AND tax_year BETWEEN 1996 AND 1998 AND NOT EXISTS (SELECT 1 FROM new_source n WHERE n.firm_id = o.firm_id AND n.client_id = o.client_id AND n.source_system = o.source_system AND n.source_txn_id = o.source_txn_id)")
add("dml13_set1_dirty_units", lambda b: M.dirty_units(_changes(b)), "SELECT DISTINCT firm_id, client_id, tax_year FROM (SELECT firm_id, client_id, o_tax_year AS tax_year FROM changes WHERE change NOT IN ('unchanged', 'untouched') UNION SELECT firm_id, client_id, n_tax_year FROM changes WHERE change NOT IN ('unchanged', 'untouched')) x WHERE tax_year IS NOT NULL")
XOR_SQL = "bit_xor(CASE WHEN NOT deleted THEN CAST('0x' || substr(row_hash, 1, 16) AS UBIGINT) ELSE 0::UBIGINT END)"
add("ag7_ag8_book_checksum", lambda b: M.checksum(b.old_snapshot), f"SELECT firm_id, CAST(CAST(x AS HUGEINT) - CASE WHEN x > 9223372036854775807 THEN 18446744073709551616::HUGEINT ELSE 0 END AS BIGINT) AS book_xor, n_live, n_deleted, n_clients, live_cents FROM (SELECT firm_id, {XOR_SQL} AS x, count(*) FILTER (WHERE NOT deleted) AS n_live, count(*) FILTER (WHERE deleted) AS n_deleted, count(DISTINCT CASE WHEN NOT deleted THEN client_id END) AS n_clients, CAST(coalesce(sum(amount_cents) FILTER (WHERE NOT deleted), 0) AS BIGINT) AS live_cents FROM old_snapshot GROUP BY firm_id) y")


def _reimport(b: Book) -> DataFrame:
    return M.verify_idempotent(M.diff(b.snapshot, b.new_source, F.expr(SCOPE)))


add("i10_import_idempotency", _reimport, "SELECT * FROM (VALUES ('book_xor', true), ('live_cents', true), ('n_clients', true), ('n_deleted', true), ('n_live', true), ('no_inserts_or_updates', true), ('no_tombstones', true)) v(\"check\", ok)", book=False)


def _digest_reimport(b: Book) -> DataFrame:
    """The same source once more: nothing but its digests is computed, and no part of the snapshot is read or written."""
    again = U.apply_source(b.imported, b.source(), lambda prefix: F.lit(True), 3)
    return M.checksum(b.imported.read("snapshot")).withColumn("parts_touched", F.lit(len(again.parts)))


add("ag7_i10_digest_reimport", _digest_reimport, f""", hashed AS (SELECT *, sha256(line_id || '|' || tax_year || '|' || amount_cents || '|' || name_norm) AS row_hash FROM live)
SELECT firm_id, CAST(CAST(x AS HUGEINT) - CASE WHEN x > 9223372036854775807 THEN 18446744073709551616::HUGEINT ELSE 0 END AS BIGINT) AS book_xor, n_live, CAST(0 AS BIGINT) AS n_deleted, n_clients, live_cents, 0 AS parts_touched
FROM (SELECT firm_id, {XOR_SQL} AS x, count(*) AS n_live, count(DISTINCT client_id) AS n_clients, CAST(sum(amount_cents) AS BIGINT) AS live_cents FROM hashed GROUP BY firm_id) y""")
add("i10_first_import_is_no_repetition", lambda b: M.verify_idempotent(_changes(b)), """, after AS (SELECT firm_id, client_id, CASE WHEN n_row_hash IS NOT NULL THEN n_amount_cents ELSE o_amount_cents END AS amount_cents, coalesce(n_row_hash, o_row_hash) AS row_hash, CASE change WHEN 'tombstoned' THEN true WHEN 'untouched' THEN o_deleted ELSE false END AS deleted FROM changes),
sums AS (SELECT 'b' AS side, firm_id, client_id, amount_cents, row_hash, deleted FROM old_snapshot UNION ALL SELECT 'a', * FROM after),
firms AS (SELECT side, firm_id, """ + XOR_SQL + """ AS book_xor, coalesce(sum(amount_cents) FILTER (WHERE NOT deleted), 0) AS live_cents, count(DISTINCT CASE WHEN NOT deleted THEN client_id END) AS n_clients, count(*) FILTER (WHERE deleted) AS n_deleted, count(*) FILTER (WHERE NOT deleted) AS n_live FROM sums GROUP BY side, firm_id),
p AS (SELECT bool_and(x.book_xor = y.book_xor) AS k1, bool_and(x.live_cents = y.live_cents) AS k2, bool_and(x.n_clients = y.n_clients) AS k3, bool_and(x.n_deleted = y.n_deleted) AS k4, bool_and(x.n_live = y.n_live) AS k5 FROM firms x JOIN firms y ON x.firm_id = y.firm_id AND x.side = 'a' AND y.side = 'b'),
q AS (SELECT count(*) FILTER (WHERE change IN ('inserted', 'updated', 'resurrected')) = 0 AS k6, count(*) FILTER (WHERE change = 'tombstoned') = 0 AS k7 FROM changes)
SELECT unnest(['book_xor', 'live_cents', 'n_clients', 'n_deleted', 'n_live', 'no_inserts_or_updates', 'no_tombstones']) AS \"check\", unnest([k1, k2, k3, k4, k5, k6, k7]) AS ok FROM p, q""".replace('\\"', '"'))


def _history(b: Book) -> DataFrame:
    key, values = ["firm_id", "client_id", "vendor_key"], ["reportable_cents", "form_required"]
    v1 = b.decisions.select(*key, *values).withColumns({"valid_from": F.lit(1), "valid_to": F.lit(None).cast("int")})
    now = b.decisions.select(*key, (F.col("reportable_cents") + F.when(F.length("vendor_key") % 2 == 0, 1).otherwise(0)).alias("reportable_cents"), "form_required")
    return M.history(v1, now, now.filter("client_id % 2 = 0").select("firm_id", "client_id").distinct(), key, values, 2)


add("dml7_scd2_history", _history, """, x AS (SELECT *, client_id % 2 = 0 AND length(vendor_key) % 2 = 0 AS changed FROM decided)
SELECT firm_id, client_id, vendor_key, reportable_cents, form_required, 1 AS valid_from, CASE WHEN changed THEN '2' END AS valid_to FROM x
UNION ALL SELECT firm_id, client_id, vendor_key, reportable_cents + 1, form_required, 2, NULL FROM x WHERE changed""")
add("dml6_evidence_upsert", lambda b: M.upsert_coalesce(b.classified.filter("client_id % 2 = 0").select("line_id", F.lit("OLD").alias("disposition")), b.classified.filter("client_id % 3 = 0").select("line_id", "disposition"), ["line_id"], [], ["disposition"]), "SELECT line_id, CASE WHEN client_id % 3 = 0 THEN disposition ELSE 'OLD' END AS disposition FROM classified WHERE client_id % 3 = 0 OR client_id % 2 = 0")
add("dml8_insert_if_absent", lambda b: M.insert_if_absent(D.exceptions(b.decided).filter("client_id % 2 = 0").select("vendor_key", "client_id", "code", F.lit(1).alias("run")), D.exceptions(b.decided).select("vendor_key", "client_id", "code", F.lit(2).alias("run")), ["vendor_key", "client_id", "code"]), "SELECT vendor_key, client_id, code, CASE WHEN client_id % 2 = 0 THEN 1 ELSE 2 END AS run FROM raised")
add("dml10_freeze_violations", lambda b: B.freeze_violations(b.filings, b.filings.withColumn("content_hash", F.when(F.substring("filing_id", 1, 1) == "0", F.lit("changed")).otherwise(F.col("content_hash")))), "SELECT firm_id, filing_id, state AS b_state, state FROM filings WHERE state IN ('BATCHED', 'SUBMITTED_UNACKNOWLEDGED') AND substr(filing_id, 1, 1) = '0'")
add("dml12_exception_acknowledgment", lambda b: V.acknowledge_exceptions(D.exceptions(b.decisions).select("firm_id", "client_id", "vendor_key", "code"), D.exceptions(b.decisions).filter("client_id % 5 = 0").select("firm_id", "client_id", "vendor_key", "code", F.lit("seen").alias("note"))), "SELECT firm_id, client_id, vendor_key, code, CASE WHEN client_id % 5 = 0 THEN 'seen' END AS note FROM raised")
add("wn3_duplicate_ordinals", lambda b: M.duplicate_ordinals(b.ledger.select("client_id", "name_norm", "method", "payment_date", "line_id"), ["client_id", "name_norm", "method"], [F.col("payment_date"), F.col("line_id")]).select("line_id", "ordinal"), "SELECT line_id, CAST(row_number() OVER (PARTITION BY client_id, name_norm, method ORDER BY payment_date, line_id) AS INTEGER) AS ordinal FROM ledger")

# -- filings ------------------------------------------------------------------

add("prj9_hsh6_hsh7_planned_filings", lambda b: b.planned.drop("withholding_cents", "recipient_name"), "SELECT filing_id, firm_id, client_id, tax_year, vendor_key, generation, state, block_reason, attention_type, content_hash, amount_cents FROM planned")
add("dml9_filing_upsert", lambda b: B.upsert(b.filings, b.planned.withColumn("content_hash", F.when(F.col("client_id") % 2 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))), """, x AS (SELECT f.firm_id, f.filing_id, f.state AS e_state, p.state AS p_state, f.content_hash AS e_hash, CASE WHEN p.client_id % 2 = 0 THEN p.content_hash || 'x' ELSE p.content_hash END AS p_hash FROM filings f JOIN planned p ON f.filing_id = p.filing_id),
y AS (SELECT *, CASE WHEN e_state IN ('READY_TO_TRANSMIT', 'BLOCKED') AND e_hash = p_hash AND e_state = p_state THEN 'keep' WHEN e_state IN ('READY_TO_TRANSMIT', 'BLOCKED') THEN 'update' WHEN e_hash = p_hash THEN 'frozen' ELSE 'amended' END AS action FROM x)
SELECT firm_id, filing_id, action, CASE WHEN action = 'update' THEN p_state ELSE e_state END AS state, CASE WHEN action = 'update' THEN p_hash ELSE e_hash END AS content_hash FROM y""")
add("wn6_sl4_batch_members", lambda b: b.members.select("filing_id", "firm_id", "client_id", "batch_no"), "SELECT filing_id, firm_id, client_id, batch_no FROM members")
add("hsh8_dml14_batch_keys", lambda b: B.batches(b.members), "SELECT firm_id, client_id, tax_year, batch_no, CAST(count(*) AS INTEGER) AS filing_count, 'b1.' || substr(replace(replace(replace(base64(unhex(sha256(firm_id || chr(31) || client_id || chr(31) || tax_year || chr(31) || string_agg(filing_id || chr(31) || generation || chr(31) || content_hash || chr(31), '' ORDER BY filing_id)))), '+', '-'), '/', '_'), '=', ''), 1, 32) AS idempotency_key FROM members GROUP BY firm_id, client_id, tax_year, batch_no")
add("jn22_set5_ack_correlation", lambda b: B.correlate(b.filings.filter("state = 'SUBMITTED_UNACKNOWLEDGED'"), b.acks), "SELECT coalesce(f.firm_id, a.firm_id) AS firm_id, coalesce(f.filing_id, a.reference) AS filing_id, CASE WHEN a.reference IS NULL THEN 'MISSING' WHEN f.filing_id IS NULL THEN 'UNEXPECTED' ELSE 'MATCHED' END AS kind, outcome FROM (SELECT * FROM filings WHERE state = 'SUBMITTED_UNACKNOWLEDGED') f FULL OUTER JOIN acks a ON f.firm_id = a.firm_id AND f.filing_id = a.reference")
add("state8_ack_apply", lambda b: B.apply_acks(b.filings.select("firm_id", "filing_id", "state"), B.correlate(b.filings.filter("state = 'SUBMITTED_UNACKNOWLEDGED'"), b.acks)).select("filing_id", "state"), "SELECT f.filing_id, coalesce(a.outcome, f.state) AS state FROM filings f LEFT JOIN acks a ON f.filing_id = a.reference AND f.state = 'SUBMITTED_UNACKNOWLEDGED'")
add("prj10_ack_outcome", lambda b: b.decided.filter("form_required").withColumnRenamed("reportable_cents", "amount_cents").select("vendor_key", "client_id", B.ack_outcome().alias("reject_code")), "SELECT vendor_key, client_id, CASE WHEN tin_bidx IS NULL THEN 'R-TIN-FORMAT' WHEN starts_with(tin_last4, '000') THEN 'R-TIN-PREFIX' WHEN reportable_cents <= 0 AND withholding_cents <= 0 THEN 'R-AMOUNT' END AS reject_code FROM decided WHERE form_required")
add("src12_endpoint_status", lambda b: B.endpoint_status(b.work, b.members, b.recorded), "SELECT w.batch_id, CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN n < filing_count THEN 'PENDING' ELSE 'RESOLVED' END AS status FROM work w LEFT JOIN (SELECT batch_id, count(*) AS n FROM members WHERE filing_id IN (SELECT filing_id FROM recorded) GROUP BY batch_id) x ON w.batch_id = x.batch_id")
add("dml11_attention_resolve", lambda b: V.resolve_attention(b.attention, b.filings.filter("client_id % 4 = 0").select("firm_id", F.col("filing_id").alias("entity_id"), F.lit(2).alias("resolved_at"))).select("entity_id", "type", "resolved_at"), "SELECT entity_id, type, CAST(coalesce(resolved_at, CASE WHEN client_id % 4 = 0 THEN 2 END) AS VARCHAR) AS resolved_at FROM attention")


def _evidence(b: Book) -> DataFrame:
    m = b.members.join(b.filings.select("filing_id", "state"), "filing_id")
    e = m.groupBy("batch_id").agg(F.count(F.lit(1)).alias("members"), F.count(F.when(F.col("state").isin("ACCEPTED", "REJECTED"), 1)).alias("acked"), F.bool_and(F.col("state") == "BATCHED").alias("absent"), F.bool_or(F.col("state") == "SUBMITTED_UNACKNOWLEDGED").alias("receipt"))
    return B.transition(b.work, e)


add("dml15_batch_transitions", _evidence, """, ev AS (SELECT m.batch_id, count(*) AS members, count(*) FILTER (WHERE f.state IN ('ACCEPTED', 'REJECTED')) AS acked, bool_and(f.state = 'BATCHED') AS absent, bool_or(f.state = 'SUBMITTED_UNACKNOWLEDGED') AS receipt FROM members m JOIN filings f ON m.filing_id = f.filing_id GROUP BY m.batch_id),
tr AS (SELECT w.batch_id, w.state AS was, w.lease_until_us, CASE WHEN absent THEN 'VOID' WHEN acked >= members THEN 'ACKNOWLEDGED' WHEN w.state = 'DISPATCHED' AND receipt THEN 'SUBMITTED' ELSE w.state END AS state FROM work w LEFT JOIN ev ON w.batch_id = ev.batch_id)
SELECT batch_id, state, CAST(CASE WHEN state = was THEN lease_until_us END AS VARCHAR) AS lease_until_us FROM tr""")
add("state5_bad_transitions", lambda b: B.bad_transitions(b.planned.select("filing_id", "state"), b.filings.select("filing_id", "state"), "filing_id", B.FILING_TRANSITIONS), "SELECT p.filing_id, p.state AS from_state, f.state AS to_state FROM planned p JOIN filings f ON p.filing_id = f.filing_id WHERE p.state = 'READY_TO_TRANSMIT' AND f.state IN ('ACCEPTED', 'REJECTED', 'SUBMITTED_UNACKNOWLEDGED')")

# -- rate, queue --------------------------------------------------------------

add("wn1_i5_rolling_window", lambda b: B.over_limit(b.calls, HOUR, LIMIT).select("firm_id", "call_id", "calls"), f"SELECT firm_id, call_id, calls FROM (SELECT firm_id, call_id, count(*) OVER (PARTITION BY firm_id ORDER BY at_us RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW) AS calls FROM calls) x WHERE calls > {LIMIT}")
add("wn2_window_peak", lambda b: B.peak(b.calls, HOUR), f"SELECT firm_id, max(calls) AS peak FROM (SELECT firm_id, count(*) OVER (PARTITION BY firm_id ORDER BY at_us RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW) AS calls FROM calls) x GROUP BY firm_id")


def _budget(b: Book) -> DataFrame:
    now = b.calls.agg(F.max("at_us")).first()[0] or 0  # the instant is a parameter
    return B.budget(b.calls, now, 24 * HOUR, 20)


add("ag21_flt7_window_counters", _budget, f", n AS (SELECT max(at_us) AS now FROM calls) SELECT firm_id, count(*) FILTER (WHERE at_us > now - {24 * HOUR}) AS used, count(*) FILTER (WHERE at_us > now - {24 * HOUR} AND call_type = 'STATUS') AS polls, greatest(20 - count(*) FILTER (WHERE at_us > now - {24 * HOUR}), 0) AS remaining, max(at_us) AS last_call FROM calls, n GROUP BY firm_id")
GRANTS, CALL_WINDOW = 2, B.safe_window_us(12 * HOUR)
add("state3_rate_admission", lambda b: B.admit(b.calls, CALL_WINDOW, GRANTS).withColumn("retry_at_us", F.col("retry_at_us").cast("string")), f"""WITH RECURSIVE calls AS (SELECT user_id AS firm_id, event_id AS call_id, epoch_us(ts) AS at_us FROM events),
o AS (SELECT firm_id, call_id, at_us, row_number() OVER (PARTITION BY firm_id ORDER BY at_us, call_id) AS k FROM calls),
walk AS (SELECT firm_id, call_id, k, true AS granted, NULL::BIGINT AS retry_at_us, [at_us] AS held FROM o WHERE k = 1
 UNION ALL SELECT o.firm_id, o.call_id, o.k, len(held) < {GRANTS} OR held[1] <= at_us - {CALL_WINDOW}, CASE WHEN len(held) < {GRANTS} OR held[1] <= at_us - {CALL_WINDOW} THEN NULL ELSE held[1] + {CALL_WINDOW} END,
  CASE WHEN len(held) < {GRANTS} THEN list_append(held, at_us) WHEN held[1] <= at_us - {CALL_WINDOW} THEN list_append(held[2:], at_us) ELSE held END FROM walk JOIN o ON o.firm_id = walk.firm_id AND o.k = walk.k + 1)
SELECT firm_id, call_id, granted, CAST(retry_at_us AS VARCHAR) AS retry_at_us FROM walk""", book=False)
POLLS = 3
add("set4_state4_priority_classes", lambda b: B.claims(b.work, NOW_US, F.lit(POLLS), 5).select("batch_id", "cls"), f"SELECT batch_id, CAST(cls AS INTEGER) AS cls FROM (SELECT *, 0 AS cls FROM work WHERE needs_reconcile UNION ALL SELECT *, 1 FROM work WHERE state = 'SEALED' UNION ALL SELECT *, 1 FROM work WHERE state IN ('DISPATCHED', 'SUBMITTED') AND NOT needs_reconcile) x WHERE next_action_us <= {NOW_US} AND (lease_until_us IS NULL OR lease_until_us < {NOW_US})")
add("sl3_queue_claim", lambda b: B.claim_next(b.work, NOW_US, F.lit(9), 5).select("batch_id", "state", "needs_reconcile"), f"SELECT batch_id, state, needs_reconcile FROM (SELECT *, 0 AS cls FROM work WHERE needs_reconcile UNION ALL SELECT *, 1 FROM work WHERE state = 'SEALED' UNION ALL SELECT *, 2 FROM work WHERE state IN ('DISPATCHED', 'SUBMITTED') AND NOT needs_reconcile) x WHERE next_action_us <= {NOW_US} AND (lease_until_us IS NULL OR lease_until_us < {NOW_US}) ORDER BY cls, next_action_us, batch_id LIMIT 1")
add("state6_stuck_sweep", lambda b: B.stuck(b.work, NOW_US, 200_000_000), f"SELECT batch_id, CASE state WHEN 'DISPATCHED' THEN 'SUBMISSION_INDETERMINATE_TOO_LONG' ELSE 'SUBMISSION_UNACKNOWLEDGED_TOO_LONG' END AS type, CASE state WHEN 'DISPATCHED' THEN 1 ELSE 4 END AS severity FROM work WHERE state IN ('DISPATCHED', 'SUBMITTED') AND next_action_us < {NOW_US - 200_000_000}")
add("state7_reconcile_gate", lambda b: B.planning_waits(b.work), "SELECT firm_id, bool_or(needs_reconcile OR state = 'DISPATCHED') AS planning_waits FROM work GROUP BY firm_id")
add("state7_reconciled_batches", lambda b: B.reconcile(b.work, B.endpoint_status(b.work, b.members, b.recorded)), """, s AS (SELECT w.*, (w.needs_reconcile OR w.state = 'DISPATCHED') AS flag, CASE WHEN n IS NULL THEN 'UNKNOWN' WHEN n < filing_count THEN 'PENDING' ELSE 'RESOLVED' END AS status FROM work w LEFT JOIN (SELECT batch_id, count(*) AS n FROM members WHERE filing_id IN (SELECT filing_id FROM recorded) GROUP BY batch_id) x ON w.batch_id = x.batch_id)
SELECT batch_id, CASE WHEN NOT flag OR state IN ('ACKNOWLEDGED', 'VOID') THEN state WHEN status = 'RESOLVED' THEN 'ACKNOWLEDGED' WHEN status = 'PENDING' THEN 'SUBMITTED' WHEN state = 'SUBMITTED' THEN state ELSE 'SEALED' END AS state,
 flag AND state IN ('ACKNOWLEDGED', 'VOID') AS needs_reconcile, CAST(CASE WHEN NOT flag OR state IN ('ACKNOWLEDGED', 'VOID') THEN lease_until_us END AS VARCHAR) AS lease_until_us FROM s""")
#: Logs of batches by the fifth hex digit of the id's hash: a plain run, a lost answer found again, one never come, and four that no run may leave.
SCRIPTS = [("x < 6", "SEAL INTENT CALL RECEIPT ACKS SETTLE"), ("x < 9", "SEAL INTENT CALL UNKNOWN FOUND ACKS SETTLE"), ("x < 12", "SEAL INTENT CALL UNKNOWN ABSENT"), ("x < 13", "SEAL CALL INTENT RECEIPT"), ("x < 14", "SEAL INTENT FOUND ACKS SETTLE"), ("x < 15", "SEAL INTENT ABSENT"), ("x = 15", "SEAL SETTLE")]
SCRIPT_SQL = "CASE " + " ".join(f"WHEN {when} THEN '{text}'" for when, text in SCRIPTS) + " END"


def _log(b: Book) -> DataFrame:
    batches = b.work.select("firm_id", "batch_id", digit("batch_id", 5).alias("x"))
    return batches.select("firm_id", "batch_id", "x", F.posexplode(F.split(F.expr(SCRIPT_SQL), " ")).alias("seq", "event")).select("firm_id", "batch_id", "seq", "event", F.when(F.col("event") == "CALL", ~F.col("x").isin(9, 10)).alias("arrived"))


PAIRS = ", ".join(f"('{was or ''}', '{event}')" for was, events in B.FOLLOWS.items() for event in events) + ", ('INTENT', 'CALL')"
AFTER_SQL = ", ".join("('{}', '{}', '{}', '{}')".format(e or "", *v) for e, v in B.AFTER_EVENT.items())
add("state9_replay_of_the_intent_log", lambda b: B.replay(_log(b)), f""", s AS (SELECT firm_id, batch_id, x, {SCRIPT_SQL} AS script FROM (SELECT firm_id, batch_id, strpos('0123456789abcdef', substr(md5(batch_id), 5, 1)) - 1 AS x FROM work) y),
e AS (SELECT firm_id, batch_id, x, unnest(string_split(script, ' ')) AS event, generate_subscripts(string_split(script, ' '), 1) AS position FROM s UNION ALL SELECT firm_id, batch_id, x, NULL, 0 FROM s),
f AS (SELECT *, CASE WHEN event <> 'CALL' THEN event END AS durable FROM e),
g AS (SELECT *, coalesce(last_value(durable IGNORE NULLS) OVER (PARTITION BY batch_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS now, coalesce(last_value(durable IGNORE NULLS) OVER (PARTITION BY batch_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS was,
 coalesce(bool_or(event = 'CALL' AND x NOT IN (9, 10)) OVER (PARTITION BY batch_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS endpoint_holds FROM f)
SELECT firm_id, batch_id, CAST(position AS BIGINT) AS position, coalesce(event, 'BEGIN') AS event, batch_state, filing_state, recovery, endpoint_holds, event IS NULL OR EXISTS (SELECT 1 FROM (VALUES {PAIRS}) p(a, z) WHERE a = was AND z = event) AS legal, NOT (endpoint_holds AND recovery IN ('PLAN', 'DISPATCH')) AS safe
FROM g JOIN (VALUES {AFTER_SQL}) a(event_, batch_state, filing_state, recovery) ON now = event_""")
add("state9_releasable_batches", lambda b: B.may_release(table(b.spark, b.sf_dir, "events").select(F.col("user_id").alias("batch_id"), F.when(F.col("event_id") % 3 == 0, 2).otherwise(1).alias("attempt_no"), F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 2 == 0).alias("sent"))), "SELECT user_id AS batch_id, max(CASE WHEN event_id % 3 = 0 THEN 2 ELSE 1 END) = 1 AND bool_and(event_id % 5 <> 0 AND event_id % 2 <> 0) AS releasable FROM events GROUP BY user_id", book=False)
add("state4_reserved_polls", lambda b: b.spark.createDataFrame([(n, B.reserved_polls(n, x)) for n, x in ((20, 0.25), (20, 0.21), (3, 0.1), (0, 0.5))], "calls int, polls int"), "SELECT CAST(calls AS INTEGER) AS calls, CAST(ceil(calls * share) AS INTEGER) AS polls FROM (VALUES (20, 0.25), (20, 0.21), (3, 0.1), (0, 0.5)) v(calls, share)", book=False)


def _windows(b: Book, slide: str | None) -> DataFrame:
    calls = table(b.spark, b.sf_dir, "events").select(F.col("user_id").alias("firm_id"), F.col("ts").cast("timestamp").alias("at"))
    found = windowed_calls(calls, "2 hours", slide=slide)
    return found.select("firm_id", F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "calls")


add("window_tumbling_calls", lambda b: _windows(b, None), "SELECT user_id AS firm_id, strftime(time_bucket(INTERVAL '2 hours', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS start, count(*) AS calls FROM events GROUP BY ALL", book=False)
add("window_sliding_calls", lambda b: _windows(b, "1 hour"), "SELECT user_id AS firm_id, strftime(date_trunc('hour', ts) - k * INTERVAL '1 hour', '%Y-%m-%d %H:%M') AS start, count(*) AS calls FROM events, (VALUES (0), (1)) v(k) GROUP BY ALL", book=False)
add("dml16_latest_attempts", lambda b: B.latest_attempts(table(b.spark, b.sf_dir, "events").select(F.col("user_id").alias("attempt_id"), F.col("event_id").alias("event_no"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("outcome"))), "SELECT user_id AS attempt_id, event_id AS event_no, CASE WHEN event_id % 4 <> 0 THEN event_type END AS outcome FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1", book=False)

GAP, DELAY = 6 * HOUR, 24 * HOUR
add("window_sessions_with_late_calls", lambda b: sessions(label_late(b.calls.withColumn("batch_no", F.col("call_id") % 5), DELAY), GAP), f"""WITH c AS (SELECT user_id AS firm_id, event_id AS call_id, epoch_us(ts) AS at_us, event_id % 5 AS batch_no FROM events),
p AS (SELECT firm_id, batch_no, max(max(at_us)) OVER (PARTITION BY firm_id ORDER BY batch_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM c GROUP BY firm_id, batch_no),
l AS (SELECT c.*, coalesce(at_us < seen - {DELAY}, false) AS late FROM c JOIN p ON p.firm_id = c.firm_id AND p.batch_no = c.batch_no),
g AS (SELECT *, CASE WHEN at_us - lag(at_us) OVER (PARTITION BY firm_id, late ORDER BY at_us, call_id) <= {GAP} THEN 0 ELSE 1 END AS fresh FROM l),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY firm_id, late ORDER BY at_us, call_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM g)
SELECT firm_id, late, min(at_us) AS start_us, max(at_us) + {GAP} AS end_us, count(*) AS calls FROM s GROUP BY firm_id, late, n""", book=False)


def _admission_stream(b: Book) -> DataFrame:
    """The calls in three portions of time, each taken by a query that goes on from the checkpoint of the one before it; a last call far ahead lets the watermark pass all others."""
    name, calls = "spark.sql.streaming.stateStore.providerClass", b.calls.select(*[F.col(c).cast("long").alias(c) for c in ("firm_id", "call_id", "at_us")])
    low, high = calls.agg(F.min("at_us"), F.max("at_us")).first()
    where, old = scratch(b.spark, "stream"), b.spark.conf.get(name)
    b.spark.conf.set(name, admission.PROVIDER)
    try:
        for k in range(3):
            third = F.least(F.floor((F.col("at_us") - low) * 3 / F.lit(max(high - low, 1))), F.lit(2))
            portion = calls.filter(third == k)
            if k == 2:
                portion = portion.unionByName(b.spark.createDataFrame([(-1, -1, (high or 0) + 10 * DELAY)], calls.schema))
            portion.write.mode("append").parquet(f"{where}/in")
            stream = admission.admit_stream(b.spark.readStream.schema(calls.schema).parquet(f"{where}/in"), CALL_WINDOW, GRANTS)
            stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        b.spark.conf.set(name, old)
    return b.spark.read.schema(admission.ADMITTED).parquet(f"{where}/out").filter("firm_id >= 0").withColumn("retry_at_us", F.col("retry_at_us").cast("string"))


add("state3_admission_stream", _admission_stream, ORACLES["state3_rate_admission"], book=False)

# -- invariants ---------------------------------------------------------------

add("i1_ag14_recorded_twice", lambda b: B.recorded_twice(b.recorded), "SELECT firm_id, filing_id, generation, count(*) AS times FROM recorded GROUP BY ALL HAVING count(*) > 1")
add("i2_jn19_recorded_never_sent", lambda b: B.recorded_never_sent(b.recorded, b.filings), "SELECT DISTINCT firm_id, filing_id FROM recorded WHERE filing_id NOT IN (SELECT filing_id FROM filings WHERE state IN ('SUBMITTED_UNACKNOWLEDGED', 'ACCEPTED', 'REJECTED'))")
add("i3_jn19_outcome_never_recorded", lambda b: B.outcome_never_recorded(b.filings, b.recorded), "SELECT firm_id, filing_id, state FROM filings WHERE state IN ('ACCEPTED', 'REJECTED') AND filing_id NOT IN (SELECT filing_id FROM recorded)")
add("i4_jn20_unscheduled", lambda b: B.unscheduled(b.filings, b.members, b.work, b.attention), "SELECT f.firm_id, f.filing_id, f.state FROM filings f WHERE state NOT IN ('ACCEPTED', 'DRAFT', 'READY_TO_TRANSMIT') AND NOT EXISTS (SELECT 1 FROM members m JOIN work w ON m.batch_id = w.batch_id WHERE m.filing_id = f.filing_id AND w.state IN ('SEALED', 'DISPATCHED', 'SUBMITTED')) AND NOT EXISTS (SELECT 1 FROM attention a WHERE a.entity_id = f.filing_id AND a.resolved_at IS NULL)")
add("i6_jn5_state_agreement", lambda b: B.disagreeing(b.filings, b.members, b.work), "SELECT w.firm_id, w.batch_id, w.state AS batch_state, f.filing_id, f.state AS filing_state FROM work w JOIN members m ON w.batch_id = m.batch_id JOIN filings f ON m.filing_id = f.filing_id WHERE (w.state = 'SEALED' AND f.state = 'SUBMITTED_UNACKNOWLEDGED') OR (w.state IN ('DISPATCHED', 'SUBMITTED') AND f.state IN ('READY_TO_TRANSMIT', 'BATCHED'))")
add("i7_outcome_evidence", lambda b: B.unexplained(b.filings), "SELECT filing_id, state FROM filings WHERE (state = 'ACCEPTED' AND record_id IS NULL) OR (state = 'REJECTED' AND reject_code IS NULL)")
add("i8_ag15_batch_shape", lambda b: B.misshapen(b.members, BATCH_SIZE - 1), f"SELECT firm_id, batch_id, count(*) AS n, count(DISTINCT client_id) AS clients FROM members GROUP BY firm_id, batch_id HAVING count(*) > {BATCH_SIZE - 1} OR count(DISTINCT client_id) > 1")
add("i9_submission_uniqueness", lambda b: B.resubmitted(b.members.unionByName(b.members.filter("client_id % 7 = 0"))), "SELECT firm_id, filing_id, generation, CAST(2 AS BIGINT) AS times FROM members WHERE client_id % 7 = 0")
add("jn21_orphan_members", lambda b: B.orphans(b.members, b.work.filter("state <> 'VOID'")), "SELECT m.firm_id, m.batch_id, m.filing_id FROM members m JOIN work w ON m.batch_id = w.batch_id WHERE w.state = 'VOID'")

# -- views --------------------------------------------------------------------


def _status(b: Book) -> DataFrame:
    clients = table(b.spark, b.sf_dir, "nation").select(F.col("n_regionkey").alias("firm_id"), F.col("n_nationkey").alias("client_id"), F.col("n_name").alias("legal_name"))
    counts, open_ = b.views.read("status").drop("bucket"), b.views.read("attention").drop("bucket")
    years = V.known_years(b.spark.createDataFrame([(1997,), (1998,)], "tax_year int"), counts)
    return V.status_of(clients, years, counts, open_)


STATUS_SQL = """, years AS (SELECT 1997 AS tax_year UNION SELECT 1998 UNION SELECT tax_year FROM filings),
counts AS (SELECT firm_id, client_id, tax_year, count(*) AS n_total, count(*) FILTER (WHERE state = 'ACCEPTED') AS n_accepted, count(*) FILTER (WHERE state = 'REJECTED') AS n_rejected, count(*) FILTER (WHERE state = 'BLOCKED') AS n_blocked, count(*) FILTER (WHERE state = 'SUBMITTED_UNACKNOWLEDGED') AS n_awaiting,
  count(*) FILTER (WHERE state IN ('DRAFT', 'READY_TO_TRANSMIT')) AS n_ready, count(*) FILTER (WHERE state = 'BATCHED') AS n_batched, CAST(sum(amount_cents) FILTER (WHERE state = 'ACCEPTED') AS BIGINT) AS accepted_cents FROM filings GROUP BY firm_id, client_id, tax_year),
att AS (SELECT firm_id, client_id, count(*) AS n_attention, min(severity) AS worst_severity FROM attention WHERE resolved_at IS NULL GROUP BY firm_id, client_id),
joined AS (SELECT n_regionkey AS firm_id, n_nationkey AS client_id, n_name AS legal_name, y.tax_year, coalesce(n_total, 0) AS n_total, coalesce(n_accepted, 0) AS n_accepted, coalesce(n_rejected, 0) AS n_rejected, coalesce(n_blocked, 0) AS n_blocked, coalesce(n_awaiting, 0) AS n_awaiting, coalesce(n_ready, 0) AS n_ready, coalesce(n_batched, 0) AS n_batched, coalesce(accepted_cents, 0) AS accepted_cents, coalesce(n_attention, 0) AS n_attention, worst_severity
 FROM nation CROSS JOIN years y LEFT JOIN counts k ON k.firm_id = n_regionkey AND k.client_id = n_nationkey AND k.tax_year = y.tax_year LEFT JOIN att a ON a.firm_id = n_regionkey AND a.client_id = n_nationkey),
status AS (SELECT *, CASE WHEN n_rejected > 0 OR n_blocked > 0 OR n_attention > 0 THEN 'NEEDS_ATTENTION' WHEN n_total = 0 THEN 'NOTHING_TO_FILE' WHEN n_accepted = n_total THEN 'FULLY_FILED' WHEN n_accepted > 0 THEN 'PARTIALLY_FILED' WHEN n_awaiting + n_batched > 0 THEN 'AWAITING_IRS' ELSE 'READY_TO_FILE' END AS status FROM joined)
"""
add("prj6_jn13_jn14_client_status", _status, STATUS_SQL + "SELECT * REPLACE (CAST(worst_severity AS VARCHAR) AS worst_severity) FROM status")
add("ag9_ag10_status_counts", lambda b: _status(b).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.sum("n_total").alias("filings"), F.min("worst_severity").alias("worst")), STATUS_SQL + "SELECT status, count(*) AS n, CAST(sum(n_total) AS BIGINT) AS filings, CAST(min(worst_severity) AS VARCHAR) AS worst FROM status GROUP BY status")
add("sl1_ranked_clients", lambda b: V.ranked(_status(b)).select("client_id", "tax_year", "status"), STATUS_SQL + "SELECT client_id, tax_year, status FROM status")
add("ag11_tiles", lambda b: V.tiles(b.filings), "SELECT count(*) AS n_total, count(*) FILTER (WHERE state = 'ACCEPTED') AS n_accepted, count(*) FILTER (WHERE state IN ('BLOCKED', 'REJECTED')) AS n_human, CAST(coalesce(sum(amount_cents) FILTER (WHERE state = 'ACCEPTED'), 0) AS BIGINT) AS accepted_cents FROM filings")
add("set1_known_years", lambda b: V.known_years(b.live, b.filings), "SELECT tax_year FROM live UNION SELECT tax_year FROM filings")


def _view(b: Book) -> DataFrame:
    return b.views.read("exceptions").drop("bucket").unionByName(V.rejected_imports(b.rejections))


VIEW_SQL = """, open_items AS (SELECT * FROM attention WHERE resolved_at IS NULL),
covered AS (SELECT a.firm_id, a.client_id, f.vendor_key, f.tax_year, a.type FROM open_items a JOIN filings f ON f.firm_id = a.firm_id AND f.filing_id = a.entity_id),
own AS (SELECT * FROM rejections WHERE run_id = (SELECT max(run_id) FROM rejections)),
ex_view AS (
 SELECT severity, type AS code, entity_type, entity_id, firm_id, client_id, 'ATTENTION:' || entity_type || ':' || entity_id || ':' || type AS dedupe_key FROM open_items
 UNION ALL SELECT CASE severity WHEN 'BLOCKING' THEN 5 ELSE 6 END, code, 'VENDOR', vendor_key, firm_id, client_id, 'DETERMINATION:' || client_id || ':' || vendor_key || ':' || code FROM raised r
  WHERE NOT EXISTS (SELECT 1 FROM covered c WHERE c.firm_id = r.firm_id AND c.client_id = r.client_id AND c.vendor_key = r.vendor_key AND c.tax_year = r.tax_year AND c.type = CASE WHEN r.code IN ('MISSING_TIN', 'MALFORMED_TIN') THEN 'VENDOR_MISSING_TIN' END)
 UNION ALL SELECT DISTINCT 7, 'IMPORT_ROWS_REJECTED', 'IMPORT', file_name || ':' || reason_code, NULL::INTEGER, NULL::INTEGER, 'IMPORT:' || file_name || ':' || reason_code FROM own)
"""
add("set3_jn18_exception_view", lambda b: _view(b).withColumns({c: F.col(c).cast("string") for c in V.CLIENT}), VIEW_SQL + "SELECT * REPLACE (CAST(firm_id AS VARCHAR) AS firm_id, CAST(client_id AS VARCHAR) AS client_id) FROM ex_view")
add("ag12_exception_groups", lambda b: V.exception_groups(_view(b)), VIEW_SQL + "SELECT severity, code, count(*) AS n FROM ex_view GROUP BY severity, code")
add("sl2_urgent_top_200", lambda b: V.urgent(_view(b))[0].withColumn("client_id", F.col("client_id").cast("string")), VIEW_SQL + "SELECT * REPLACE (CAST(client_id AS VARCHAR) AS client_id) FROM ex_view ORDER BY severity, dedupe_key LIMIT 200")
add("sl2_truncated_flag", lambda b: V.urgent(_view(b))[1], VIEW_SQL + "SELECT count(*) AS n, count(*) > 200 AS truncated FROM ex_view")
add("ag6_ag13_rejection_summary", lambda b: V.rejection_summary(b.rejections), ", own AS (SELECT *, row_number() OVER (PARTITION BY file_name, reason_code ORDER BY line_no) AS k FROM rejections WHERE run_id = (SELECT max(run_id) FROM rejections)) SELECT file_name, reason_code, count(*) AS n_rows, string_agg(CASE WHEN k <= 5 THEN CAST(line_no AS VARCHAR) END, ',' ORDER BY line_no) AS sample_lines FROM own GROUP BY file_name, reason_code")
add("flt9_latest_run", lambda b: V.latest_run(b.rejections).select("run_id", "line_no"), "SELECT run_id, line_no FROM rejections WHERE run_id = (SELECT max(run_id) FROM rejections)")
add("ag20_rejection_histogram", lambda b: b.rejections.groupBy("reason_code").agg(F.count(F.lit(1)).alias("n")), "SELECT reason_code, count(*) AS n FROM rejections GROUP BY reason_code")
add("sl7_open_attention", lambda b: V.open_attention(b.attention, b.filings), "SELECT a.severity, a.type, a.entity_id, f.recipient_name FROM attention a JOIN filings f ON f.filing_id = a.entity_id WHERE a.resolved_at IS NULL")
add("ag12_open_by_type", lambda b: V.open_by_type(b.attention), "SELECT severity, type, count(*) AS n FROM attention WHERE resolved_at IS NULL GROUP BY severity, type")
add("ag17_outstanding_work", lambda b: V.outstanding(b.work), "SELECT state, count(*) AS n, CAST(sum(filing_count) AS BIGINT) AS filings, count(*) FILTER (WHERE needs_reconcile) AS to_reconcile, min(next_action_us) AS next_action_us FROM work GROUP BY state")
add("ag16_ag18_distinct_and_scalars", lambda b: b.live.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("client_id").alias("clients"), F.count_distinct("tin_bidx").alias("tins")), "SELECT count(*) AS n, count(DISTINCT client_id) AS clients, count(DISTINCT tin_bidx) AS tins FROM live")
add("jn11_sl6_client_detail", lambda b: V.client_detail(b.decisions, b.filings, 3), "SELECT d.vendor_key, d.display_name, d.reportable_cents, f.filing_id, f.state AS filing_state FROM decided d LEFT JOIN filings f ON f.client_id = d.client_id AND f.vendor_key = d.vendor_key AND f.tax_year = d.tax_year WHERE d.client_id = 3")
add("sl6_payment_evidence", lambda b: V.payment_evidence(b.classified, 3), "SELECT vendor_key, CAST(payment_date AS VARCHAR) AS payment_date, line_id, amount_cents, disposition, disposition LIKE 'COUNTED%' AS counted FROM classified WHERE client_id = 3")
add("sl5_batches_planner_list", lambda b: V.batch_list(b.work), "SELECT firm_id, client_id, batch_id, state FROM work")
add("flt5_flt10_point_and_list_lookups", lambda b: V.lookup(b.filings, client_id=(1, 5, 9), state=("ACCEPTED", "REJECTED")).select("filing_id", "state"), "SELECT filing_id, state FROM filings WHERE client_id IN (1, 5, 9) AND state IN ('ACCEPTED', 'REJECTED')")
add("flt6_is_distinct_from", lambda b: _changes(b).filter(~F.col("o_row_hash").eqNullSafe(F.col("n_row_hash"))).select("source_txn_id"), "SELECT source_txn_id FROM changes WHERE o_row_hash IS DISTINCT FROM n_row_hash")
add("jn16_semi_joins", lambda b: b.filings.join(b.members.join(b.work.filter("state = 'SEALED'"), "batch_id", "left_semi"), "filing_id", "left_semi").select("filing_id"), "SELECT filing_id FROM filings WHERE filing_id IN (SELECT filing_id FROM members WHERE batch_id IN (SELECT batch_id FROM work WHERE state = 'SEALED'))")


def _proved_status(b: Book) -> DataFrame:
    """One firm's status view over stored tables, after its plan proved that no other firm's rows are read."""
    own = FirmSession(b.spark, {"status": lambda: b.views.read("status"), "attention": lambda: b.views.read("attention")}, 2)
    nation = table(b.spark, b.sf_dir, "nation").filter("n_regionkey = 2")
    clients = nation.select(F.lit(2).alias("firm_id"), F.col("n_nationkey").alias("client_id"), F.col("n_name").alias("legal_name"))
    years = b.spark.createDataFrame([(1997,), (1998,)], "tax_year int")
    counts, open_ = own.proved(own.table("status").drop("bucket")), own.proved(own.table("attention").drop("bucket"))
    return V.status_of(clients, years, counts, open_)


add("sec1_sec2_proved_by_plan", _proved_status, STATUS_SQL + "SELECT * REPLACE (CAST(worst_severity AS VARCHAR) AS worst_severity) FROM status WHERE firm_id = 2")
CATALOG = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


def _catalog(b: Book) -> DataFrame:
    """The tables as registered views, and what the start-up check sees of them."""
    for t in CATALOG:
        table(b.spark, b.sf_dir, t).createOrReplaceTempView(f"checked_{t}")
    b.views.read("status").createOrReplaceTempView("checked_status")
    try:
        facts = [(n.removeprefix("checked_"), columns, firm) for n, columns, firm, _ in catalog_facts(b.spark) if n.startswith("checked_")]
    finally:
        for t in (*CATALOG, "status"):
            b.spark.catalog.dropTempView(f"checked_{t}")
    return b.spark.createDataFrame(facts, "table_name string, n_columns long, has_firm boolean")


add("sec3_flt11_catalog", _catalog, f"SELECT table_name, count(*) AS n_columns, bool_or(column_name = 'firm_id') AS has_firm FROM information_schema.columns WHERE table_name IN {CATALOG} GROUP BY table_name UNION ALL SELECT 'status', {len(V.CLIENT) + len(V.COUNTS) + 4}, true", book=False)
add("sec1_firm_session", lambda b: FirmSession(b.spark, {"ledger": lambda: b.ledger}, 2).table("ledger").groupBy("firm_id", "client_id").agg(F.count(F.lit(1)).alias("n")), "SELECT firm_id, client_id, count(*) AS n FROM ledger WHERE firm_id = 2 GROUP BY firm_id, client_id")
add("prj11_money_display", lambda b: b.decided.select("firm_id", "client_id", "vendor_key", S.format_cents(F.abs("reportable_cents")).alias("shown")), "SELECT firm_id, client_id, vendor_key, format('{:,}', abs(reportable_cents) // 100) || '.' || lpad(CAST(abs(reportable_cents) % 100 AS VARCHAR), 2, '0') AS shown FROM decided")


def _chain(b: Book) -> DataFrame:
    e = table(b.spark, b.sf_dir, "events")
    w = Window.partitionBy("firm_id").orderBy("event_id")
    return audit.extend(e.select(F.col("user_id").alias("firm_id"), "event_id", F.lit("system").alias("actor"), F.col("event_type").alias("action"), F.col("event_id").cast("string").alias("entity_id"), "props").withColumn("seq", F.row_number().over(w).cast("long")).withColumn("detail", F.when(F.col("event_id") % 5 != 0, F.col("props"))))


def _tampered(b: Book) -> DataFrame:
    chain = _chain(b)
    heads = audit.pin_heads(chain)
    bad = chain.filter(~((F.col("firm_id") % 7 == 1) & (F.col("seq") == 2))).withColumn("action", F.when((F.col("firm_id") % 5 == 0) & (F.col("seq") == 1), "forged").otherwise(F.col("action")))
    return audit.verify(bad, heads)


add("wn4_hsh10_sec6_audit_verify", _tampered, ", e AS (SELECT user_id AS firm_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT firm_id, seq, 'EDITED' AS problem FROM e WHERE firm_id % 5 = 0 AND seq = 1 UNION ALL SELECT firm_id, seq, 'GAP' FROM e WHERE firm_id % 7 = 1 AND seq = 3 UNION ALL SELECT firm_id, seq, 'TRUNCATED' FROM e WHERE firm_id % 7 = 1 AND seq = 2 AND n = 2")
LINK_SQL = "sha256(unhex(prev) || " + " || ".join(f"CASE WHEN {c} IS NULL THEN unhex('0000000000') ELSE unhex('01' || printf('%08x', octet_length(encode({c})))) || encode({c}) END" for c in ("CAST(o.firm_id AS VARCHAR)", "CAST(o.seq AS VARCHAR)", "o.actor", "o.action", "o.entity_id", "o.detail")) + ")"
add("dml18_audit_chain", _chain, f"""WITH RECURSIVE o AS (SELECT user_id AS firm_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS seq, 'system' AS actor, event_type AS action, CAST(event_id AS VARCHAR) AS entity_id, CASE WHEN event_id % 5 <> 0 THEN props END AS detail FROM events),
walk AS (SELECT firm_id, seq, actor, action, entity_id, detail, prev AS prev_hash, {LINK_SQL} AS hash FROM (SELECT *, repeat('0', 64) AS prev FROM o WHERE seq = 1) o
 UNION ALL SELECT o.firm_id, o.seq, o.actor, o.action, o.entity_id, o.detail, o.prev, {LINK_SQL} FROM (SELECT o.*, w.hash AS prev FROM walk w JOIN o ON o.firm_id = w.firm_id AND o.seq = w.seq + 1) o)
SELECT firm_id, seq, actor, action, entity_id, detail, prev_hash, hash FROM walk""", book=False)

# -- row functions on stated values -------------------------------------------

fixture("str1_name_norm", "raw string", [("José Núñez",), ("Acme Plumbing, L.L.C.",), ("ACME PLUMBING CO INC",), ("J P Morgan",), ("J.P. Morgan",), ("The X",), ("Limited",), ("Anderson Group",), ("A B C D E Corp",), ("  ",), (None,), ("Ａcme ﬁlms",)],
    lambda d: S.normalize_names(d, "raw", "norm").select("raw", "norm"),
    "SELECT * FROM (VALUES ('José Núñez', 'JOSE NUNEZ'), ('Acme Plumbing, L.L.C.', 'ACME PLUMBING'), ('ACME PLUMBING CO INC', 'ACME PLUMBING'), ('J P Morgan', 'JP MORGAN'), ('J.P. Morgan', 'JP MORGAN'), ('The X', 'X'), ('Limited', 'LIMITED'), ('Anderson Group', 'ANDERSON GROUP'), ('A B C D E Corp', 'A B C D E'), ('  ', ''), (NULL, ''), ('Ａcme ﬁlms', 'ACME FILMS')) v(raw, norm)")
fixture("str2_payment_method", "raw string", [("Check #1042",), ("chk 88213",), ("wire ref 55",), ("credit_card",), ("P-Card",), ("zelle",), ("  Direct   Deposit ",), ("third-party network",), ("",), (None,), ("amex no. 9",)],
    lambda d: d.select("raw", S.payment_method(F.col("raw")).alias("method")),
    "SELECT * FROM (VALUES ('Check #1042', 'CHECK'), ('chk 88213', 'CHECK'), ('wire ref 55', 'WIRE'), ('credit_card', 'CREDIT_CARD'), ('P-Card', 'CREDIT_CARD'), ('zelle', 'UNKNOWN'), ('  Direct   Deposit ', 'ACH'), ('third-party network', 'TPSO'), ('', 'UNKNOWN'), (NULL, 'UNKNOWN'), ('amex no. 9', 'CREDIT_CARD')) v(raw, method)")
fixture("str3_entry_type", "raw string, cents long", [("credit memo", 5), ("Voided", 5), (None, -5), ("", 5), ("odd", -1), ("bill-payment", -1), ("refunded", 3)],
    lambda d: d.select("raw", "cents", S.entry_type(F.col("raw"), F.col("cents")).alias("entry")),
    "SELECT raw, CAST(cents AS BIGINT) AS cents, entry FROM (VALUES ('credit memo', 5, 'REVERSAL'), ('Voided', 5, 'VOID'), (NULL, -5, 'REVERSAL'), ('', 5, 'PAYMENT'), ('odd', -1, 'REVERSAL'), ('bill-payment', -1, 'PAYMENT'), ('refunded', 3, 'REFUND')) v(raw, cents, entry)")
fixture("str4_expense_class", "raw string", [(None,), ("contract labor",), ("GOODS",), ("rental",), ("mileage",), ("mystery",)],
    lambda d: d.select("raw", S.expense_class(F.col("raw")).alias("class")),
    "SELECT * FROM (VALUES (NULL, 'SERVICES'), ('contract labor', 'SERVICES'), ('GOODS', 'MERCHANDISE'), ('rental', 'RENT'), ('mileage', 'REIMBURSEMENT'), ('mystery', 'OTHER')) v(raw, class)")
fixture("str5_tin", "raw string, declared string", [("12-3456789", None), ("123-45-6789", ""), ("123456789", "ein"), ("12-34567", None), ("N/A", None), (None, None), ("000-00-0000", "SSN"), ("123456789", None)],
    lambda d: d.select("raw", S.tin_status(F.col("raw")).alias("status"), F.when(F.length(S.tin_digits(F.col("raw"))) == 9, S.tin_kind(F.col("raw"), F.col("declared"))).alias("kind")),
    "SELECT * FROM (VALUES ('12-3456789', 'PRESENT', 'EIN'), ('123-45-6789', 'PRESENT', 'SSN'), ('123456789', 'PRESENT', 'EIN'), ('12-34567', 'MALFORMED', NULL), ('N/A', 'MALFORMED', NULL), (NULL, 'MISSING', NULL), ('000-00-0000', 'PRESENT', 'SSN'), ('123456789', 'PRESENT', 'UNKNOWN')) v(raw, status, kind)")
fixture("str6_str7_masks", "raw string", [("ssn 123-45-6789 ein 12-3456789 bare 987654321 phone 5551234567",), ("no numbers",), ("12-34567",), ("ab",), ("1-123-45-6789 or 12-3456789-0",), ("a1234567890 (123456789)",)],
    lambda d: d.select("raw", S.log_mask(F.col("raw")).alias("masked"), S.tin_mask(F.col("raw")).alias("tin"), S.redacted_line(F.col("raw"), F.lit(None), F.repeat(F.lit("z"), F.length("raw") * 20)).alias("line")),
    """SELECT *, CASE WHEN length(l) > 1024 THEN substr(l, 1, 1024) || '...' ELSE l END AS line FROM (SELECT *, masked || ',,' || repeat('z', length(raw) * 20) AS l FROM (VALUES ('ssn 123-45-6789 ein 12-3456789 bare 987654321 phone 5551234567', 'ssn ***-**-6789 ein ***-**-6789 bare ***-**-4321 phone 5551234567', '***-**-4567'), ('no numbers', 'no numbers', '***'), ('12-34567', '12-34567', '***-**-4567'), ('ab', 'ab', '***'),
 ('1-123-45-6789 or 12-3456789-0', '1-123-45-6789 or 12-3456789-0', '***-**-7890'), ('a1234567890 (123456789)', 'a1234567890 (***-**-6789)', '***-**-6789')) v(raw, masked, tin)) x""".replace("SELECT *, CASE", "SELECT raw, masked, tin, CASE"))
#: A mask's neighbours are taken along and put back, twice, as one of them may belong to two numbers.
MASKED_SQL = "text"
for form, last in (("[0-9]{3}-[0-9]{2}-([0-9]{4})", "-"), ("[0-9]{2}-[0-9]{3}([0-9]{4})", "-"), ("[0-9]{5}([0-9]{4})", "")):
    for _ in range(2):
        MASKED_SQL = f"regexp_replace({MASKED_SQL}, '(^|[^0-9{last}]){form}($|[^0-9{last}])', '\\1***-**-\\2\\3', 'g')"
add("str6_masked_documents", lambda b: table(b.spark, b.sf_dir, "documents").select("doc_id", F.col("text"), S.log_mask(F.col("text")).alias("masked")).filter("masked <> text").select("doc_id", F.sha2("masked", 256).alias("masked_sha256")), f"SELECT doc_id, sha256(masked) AS masked_sha256 FROM (SELECT doc_id, text, {MASKED_SQL} AS masked FROM documents) x WHERE masked <> text", book=False)
fixture("dt1_dt2_dates", "raw string, dialect string", [("03/04/2025", "QUICKBOOKS"), ("3/4/2025", "QUICKBOOKS"), ("31/02/2025", "QUICKBOOKS"), ("2025/03/04", "XERO"), ("2025-13-45", "XERO"), ("4-Mar-25", "SPREADSHEET"), ("3/4/25", "SPREADSHEET"), ("45720", "SPREADSHEET"), ("99999", "SPREADSHEET"), ("2025-03-04", "CANONICAL"), ("TBD", "CANONICAL"), (None, "CANONICAL")],
    lambda d: d.select("raw", "dialect", F.coalesce(*[F.when(F.col("dialect") == x, S.parse_date(F.col("raw"), x)) for x in S.DATE_FORMATS]).cast("string").alias("day")),
    "SELECT * FROM (VALUES ('03/04/2025', 'QUICKBOOKS', '2025-03-04'), ('3/4/2025', 'QUICKBOOKS', '2025-03-04'), ('31/02/2025', 'QUICKBOOKS', NULL), ('2025/03/04', 'XERO', '2025-03-04'), ('2025-13-45', 'XERO', NULL), ('4-Mar-25', 'SPREADSHEET', '2025-03-04'), ('3/4/25', 'SPREADSHEET', '2025-03-04'), ('45720', 'SPREADSHEET', '2025-03-04'), ('99999', 'SPREADSHEET', NULL), ('2025-03-04', 'CANONICAL', '2025-03-04'), ('TBD', 'CANONICAL', NULL), (NULL, 'CANONICAL', NULL)) v(raw, dialect, day)")
add("dt3_dt4_deadlines", lambda b: b.live.select("tax_year").distinct().select("tax_year", S.filing_deadline(F.col("tax_year")).alias("deadline")), "SELECT DISTINCT tax_year, CAST(CAST(d + CASE dayofweek(d) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END * INTERVAL 1 DAY AS DATE) AS VARCHAR) AS deadline FROM (SELECT tax_year, make_date(tax_year + 1, 1, 31) AS d FROM live) x")
fixture("num1_num2_amounts", "raw string", [("$1,234.56",), ("($1,234.56)",), ("USD 10",), ("−5.00",), ("12.345",), ("--500.00",), ("1,2,3.4",), ("$$100",), ("twelve dollars",), ("",), (None,)],
    lambda d: d.select("raw", S.exact_cents(S.parse_amount(F.col("raw"))).cast("string").alias("cents"), S.parse_amount(F.col("raw")).isNull().alias("unparseable")),
    "SELECT raw, CAST(cents AS VARCHAR) AS cents, unparseable FROM (VALUES ('$1,234.56', 123456, false), ('($1,234.56)', -123456, false), ('USD 10', 1000, false), ('−5.00', -500, false), ('12.345', NULL, false), ('--500.00', NULL, true), ('1,2,3.4', 12340, false), ('$$100', 10000, false), ('twelve dollars', NULL, true), ('', NULL, true), (NULL, NULL, true)) v(raw, cents, unparseable)")
fixture("num3_withholding", "raw string", [("-96.00",), ("1.234",), ("x",), (None,)], lambda d: d.select("raw", S.withholding_cents(F.col("raw")).alias("cents")), "SELECT raw, CAST(cents AS BIGINT) AS cents FROM (VALUES ('-96.00', 9600), ('1.234', 0), ('x', 0), (NULL, 0)) v(raw, cents)")
fixture("num4_format_cents", "cents long", [(123456789,), (-5,), (0,)], lambda d: d.select("cents", S.format_cents(F.col("cents")).alias("shown")), "SELECT CAST(cents AS BIGINT) AS cents, shown FROM (VALUES (123456789, '1,234,567.89'), (-5, '-0.05'), (0, '0.00')) v(cents, shown)")
fixture("num5_backoff", "n int", [(1,), (2,), (5,), (9,)], lambda d: d.select("n", S.backoff_ms(F.col("n")).alias("ms"), S.jittered_ms(S.backoff_ms(F.col("n")), S.hash_fraction(F.lit("seed"), F.lit("key"), F.col("n"))).alias("jittered")),
    "SELECT CAST(n AS INTEGER) AS n, CAST(ms AS BIGINT) AS ms, CAST(1 + floor(CAST('0x' || substr(sha256('seed|key|' || n), 1, 14) AS BIGINT)::DOUBLE / 72057594037927936.0 * (ms - 1)) AS BIGINT) AS jittered FROM (VALUES (1, 1000), (2, 2000), (5, 16000), (9, 60000)) v(n, ms)")
add("hsh1_row_hash", lambda b: b.ledger.select("line_id", S.fields_hash(F.col("client_id"), F.col("name_norm"), F.col("tin_bidx"), F.col("amount_cents")).alias("row_hash")), "SELECT line_id, sha256(client_id || chr(31) || name_norm || chr(31) || coalesce(tin_bidx, '') || chr(31) || amount_cents || chr(31)) AS row_hash FROM ledger")
add("hsh2_natural_id", lambda b: b.ledger.select("line_id", S.natural_id([F.col("client_id"), F.col("name_norm"), F.col("tin_bidx")], F.lit(1)).alias("txn_id")), "SELECT line_id, 'H:' || substr(sha256(client_id || chr(31) || name_norm || chr(31) || coalesce(tin_bidx, '') || ':1'), 1, 16) AS txn_id FROM ledger")
fixture("hsh3_hsh4_blind_index", "firm long, value string", [(1, "123456789"), (2, "123456789")], lambda d: d.select("firm", S.tin_index(b"k" * 32, F.col("firm"), F.col("value")).alias("tin_bidx"), S.name_index(b"k" * 32, F.col("firm"), F.lit("ACME")).alias("name_bidx")),
    "SELECT firm, tin_bidx, name_bidx FROM (SELECT CAST(f AS BIGINT) AS firm, sha256(unhex(repeat('37', 32) || repeat('5c', 32)) || unhex(sha256(unhex(repeat('5d', 32) || repeat('36', 32)) || encode(f || ':123456789')))) AS tin_bidx, sha256(unhex(repeat('37', 32) || repeat('5c', 32)) || unhex(sha256(unhex(repeat('5d', 32) || repeat('36', 32)) || encode(f || ':name:ACME')))) AS name_bidx FROM (VALUES (1), (2)) v(f)) x")
KEYS = {1: b"0" * 32, 2: b"1" * 32}
fixture("hsh5_encryption_round_trip", "digits string, aad string", [("123456789", "1:2:x"), ("000112222", "1:3:y")],
    lambda d: d.withColumns({"old": S.encrypt_tin(F.col("digits"), {1: KEYS[1]}, F.col("aad")), "new": S.encrypt_tin(F.col("digits"), KEYS, F.col("aad"))}).select("digits", F.col("new.key_version").alias("key_version"), S.decrypt_tin(F.col("old"), KEYS, F.col("aad")).alias("opened_old"), S.decrypt_tin(F.col("new"), KEYS, F.col("aad")).alias("opened"), S.decrypt_tin(F.col("new"), KEYS, F.lit("other")).alias("wrong_aad"), S.decrypt_tin(F.col("new"), {1: KEYS[1]}, F.col("aad")).alias("lost_key")),
    "SELECT *, 2 AS key_version, digits AS opened_old, digits AS opened, NULL::VARCHAR AS wrong_aad, NULL::VARCHAR AS lost_key FROM (VALUES ('123456789'), ('000112222')) v(digits)")
fixture("hsh7_content_hash_of_the_wire_number", "firm_id int, client_id int, tax_year int, vendor_key string, form_required boolean, tin_status string, tin_bidx string, tin_last4 string, reportable_cents long, withholding_cents long, display_name string, number string, sent int", [(1, 2, 2025, "TIN:a", True, "PRESENT", "a", "6789", 70000, 0, "ACME", "123456789", 1), (1, 2, 2025, "TIN:a", True, "PRESENT", "a", "6789", 70000, 0, "ACME", "123456789", 2), (1, 2, 2025, "NAME:b", False, "MISSING", None, None, 5, 0, "B", None, 1)],
    lambda d: B.plan(d, F.col("number"), F.col("sent")).select("generation", "content_hash", "state"),
    "SELECT CAST(g AS INTEGER) AS generation, sha256('v1' || chr(31) || h || chr(31) || g || chr(31) || '2025' || chr(31) || '123456789' || chr(31) || 'ACME' || chr(31) || '70000' || chr(31) || '0' || chr(31)) AS content_hash, 'READY_TO_TRANSMIT' AS state FROM (SELECT g, substr(x, 1, 8) || '-' || substr(x, 9, 4) || '-5' || substr(x, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(x, 17, 1)) - 1) % 4 + 1, 1) || substr(x, 18, 3) || '-' || substr(x, 21, 12) AS h FROM (SELECT unnest([1, 2]) AS g, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('1|2|2025|TIN:a')) AS x) y) z")
fixture("jsn2_canonical_json", "a string, b string", [("x", 'say "hi"'), ("é", None)], lambda d: d.select(S.canonical_json(F.create_map(F.lit("zeta"), F.col("a"), F.lit("alpha"), F.coalesce("b", F.lit("")))).alias("json")), """SELECT * FROM (VALUES ('{"alpha":"say \\"hi\\"","zeta":"x"}'), ('{"alpha":"","zeta":"é"}')) v(json)""".replace("\\\\", "\\"))
add("prj11_date_display", lambda b: table(b.spark, b.sf_dir, "events").select("event_id", S.display_date(F.col("ts")).alias("day"), S.display_time(F.col("ts")).alias("minute")), "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events", book=False)
add("hsh11_failure_roll", lambda b: b.filings.select("filing_id", (F.floor(S.hash_fraction(F.lit("seed"), F.col("filing_id"), F.lit(1)) * 1000)).cast("long").alias("roll")), "SELECT filing_id, CAST(floor(CAST('0x' || substr(sha256('seed|' || filing_id || '|1'), 1, 14) AS BIGINT)::DOUBLE / 72057594037927936.0 * 1000) AS BIGINT) AS roll FROM filings")

# -- exports ------------------------------------------------------------------


def _read_back(b: Book) -> DataFrame:
    """Judged records of the whole ledger, written as an export of three systems with planted defects and read back."""
    d, e = digit("line_id", 1), digit("line_id", 2)
    kind = F.when(d == 0, F.when(e == 0, "amount").when(e == 1, "date").when(e == 2, "client").when(e == 3, "subcent").when(e == 4, "noclient").when(e == 5, "currency").when(e == 6, "vendor").when(e == 7, "ragged"))
    where = scratch(b.spark, "export")
    b.spent.append(where)
    writer.write_export(b.ledger.withColumn("defect", kind), where, RULES.tax_year, list(range(1992, 2003)))
    m = export.read_manifest(b.spark, where)
    clients = export.read_clients(b.spark, where)
    raw = None
    for name, system in m.files:
        part = export.read_payments(b.spark, f"{where}/{name}", system)
        raw = part if raw is None else raw.unionByName(part)
    return export.judge(raw, clients)


def _import(b: Book) -> tuple[DataFrame, DataFrame]:
    """(judged records, payments) of that export, judged once in the session."""
    judged = b.stored("judged", lambda: _read_back(b))
    return judged, export.normalize(judged, 1, b"key")


def _aborted(b: Book) -> DataFrame:
    """An import that the guard stops after one that it let through: the second's rejections, and the book as the first left it."""
    judged, scope = _import(b)[0], lambda prefix: F.lit(True)
    store = Store(b.spark, scratch(b.spark, "aborted"))
    U.import_judged(store, judged, 1, b"key", scope, 1)
    try:
        U.import_judged(store, judged.withColumn("amount_value", F.col("amount_value") * 2), 1, b"key", scope, 2, most_rejected=0.0)
    except export.TooManyRejections:
        pass
    told = store.read("rejections").filter("run_id = 2").groupBy(F.col("reason_code").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("cents"))
    book = store.read("snapshot").filter("not deleted").agg(F.lit("live").alias("what"), F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("cents"))
    runs = store.read("runs").groupBy(F.concat_ws(" ", F.lit("run"), "run_id", "state").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("cents"))
    return told.unionByName(book).unionByName(runs).withColumn("cents", F.col("cents").cast("string"))


DEFECT_SQL = """, spoiled AS (SELECT *, strpos('0123456789abcdef', substr(md5(line_id), 1, 1)) - 1 AS d, strpos('0123456789abcdef', substr(md5(line_id), 2, 1)) - 1 AS e FROM ledger)
"""
IMPORTED = ["source_system", "client_id", "tax_year", "method", "entry_type", "expense_class", "tin_status"]
add("src1_src9_import_round_trip", lambda b: _import(b)[1].groupBy(*IMPORTED).agg(F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("cents"), F.count_distinct("name_norm").alias("names"), F.min("payment_date").alias("first_day"), F.max("payment_date").alias("last_day")),
    DEFECT_SQL + """, i AS (SELECT source_system, 'C-' || client_id AS client_id, tax_year, method, CASE WHEN entry_type = 'VOID' AND source_system <> 'SPREADSHEET' THEN 'VOID' WHEN amount_cents < 0 THEN 'REVERSAL' ELSE 'PAYMENT' END AS entry_type, expense_class, tin_status, amount_cents, name_norm, payment_date FROM spoiled WHERE NOT (d = 0 AND e <= 7))
SELECT source_system, client_id, tax_year, method, entry_type, expense_class, tin_status, count(*) AS n, CAST(sum(amount_cents) AS BIGINT) AS cents, count(DISTINCT name_norm) AS names, CAST(min(payment_date) AS VARCHAR) AS first_day, CAST(max(payment_date) AS VARCHAR) AS last_day FROM i GROUP BY ALL""")
add("flt2_snk3_rejections", lambda b: export.rejections(_import(b)[0], 1).groupBy(F.regexp_replace("file_name", r"\.csv$", "").alias("file_name"), "reason_code").agg(F.count(F.lit(1)).alias("n")),
    DEFECT_SQL + "SELECT 'payments-' || lower(source_system) AS file_name, CASE e WHEN 0 THEN 'UNPARSEABLE_AMOUNT' WHEN 1 THEN 'UNPARSEABLE_DATE' WHEN 2 THEN 'UNKNOWN_CLIENT_REF' WHEN 3 THEN 'SUB_CENT_AMOUNT' WHEN 4 THEN 'MISSING_CLIENT_REF' WHEN 5 THEN 'UNSUPPORTED_CURRENCY' WHEN 6 THEN 'UNIDENTIFIABLE_VENDOR' ELSE 'RAGGED_ROW' END AS reason_code, count(*) AS n FROM spoiled WHERE d = 0 AND e <= 7 GROUP BY ALL")


#: Memos as they stand in a file, by the first hex digits of the line id's hash: literal marks, doubled quotes, line breaks, long cells, text after a closing quote, an extra delimiter.
LONG_CELL = 'a line of text, with ""quotes""\\n'
RAW_MEMO = [
    ("d = 0", "'5\" pipe'"), ("d = 1", "'\"say \"\"hi\"\", twice\"'"), ("d = 2", "'\"first\\nsecond, \"\"third\"\"\\n\"'"), ("d = 3", "'\"Big \"Bob\" Henderson'"), ("d = 4", "'one, two'"), ("d = 5", "'say \"\"hi\"\"'"),
    ("d = 6", "'\"\"'"), ("d = 7", "'\"12 inch\"\"\"'"), ("d = 8 and e = 0 and f = 0", f"concat('\"', repeat('{LONG_CELL}', 1900), '\"')"), ("d = 9", "'\"plain\"  '"),
]


def _quoted(b: Book, **options) -> DataFrame:
    """The ledger as a file whose memos hold quotes of all kinds, read back by splits."""
    raw = F.lit("plain")
    for when, text in reversed(RAW_MEMO):
        raw = F.when(F.expr(when), F.expr(text)).otherwise(raw)
    rows = b.ledger.withColumns({"d": digit("line_id", 1), "e": digit("line_id", 2), "f": digit("line_id", 3)})
    where = f"{scratch(b.spark, 'quoted')}/payments.csv"
    records.write_lines(rows.select(F.col("line_id").alias("key"), F.concat_ws(",", "line_id", F.lit("03/04/2025"), raw, records.cell(F.col("name_raw"))).alias("value")), "Txn ID,Date,Memo,Vendor", where, **options)
    got = export.read_payments(b.spark, where, "QUICKBOOKS")
    return got.select("line_no", "source_txn_id", "vendor_name", F.md5(F.coalesce("memo", F.lit(""))).alias("memo_md5"), F.char_length(F.coalesce("memo", F.lit(""))).cast("long").alias("memo_chars"), (F.col("n_fields") == F.col("n_headers")).alias("regular"))


def _guard(b: Book) -> DataFrame:
    n, bad = export.guard(_import(b)[0])
    return b.spark.createDataFrame([(n, bad)], "rows_read long, rows_rejected long")


def _generated(b: Book) -> DataFrame:
    """What the planted cases of a generated ledger are decided as, among its other payments."""
    lines = generator.ledger(b.spark, generator.Shape(clients_a_firm=5, most_rows=2_000), copies=25)
    decided = D.determine(lines, b.spark.createDataFrame([], "firm_id int, client_id int, alias_key string, canonical_key string"), RuleSet(2025, 60_000))[1]
    own = decided.withColumn("fixture", F.regexp_extract("display_name", "^Fixture ([a-z_0-9]+) [0-9]", 1)).filter("fixture <> ''")
    return own.groupBy("fixture").agg(F.count(F.lit(1)).alias("vendors"), *[F.sum(c).alias(c) for c in ("gross_cents", "card_excluded_cents", "reversal_cents", "reportable_cents", "withholding_cents")])


CASE_SQL = ", ".join(str((case, 25 * vendors, *(25 * x for x in sums))) for case, _, sums, vendors, _ in generator.CASES)
add("src11_generated_cases", _generated, f"SELECT fixture, CAST(vendors AS BIGINT) AS vendors, CAST(gross_cents AS BIGINT) AS gross_cents, CAST(card_excluded_cents AS BIGINT) AS card_excluded_cents, CAST(reversal_cents AS BIGINT) AS reversal_cents, CAST(reportable_cents AS BIGINT) AS reportable_cents, CAST(withholding_cents AS BIGINT) AS withholding_cents FROM (VALUES {CASE_SQL}) v(fixture, vendors, gross_cents, card_excluded_cents, reversal_cents, reportable_cents, withholding_cents)", book=False)
QUOTED_SQL = r""", q AS (SELECT line_id, name_raw, strpos('0123456789abcdef', substr(md5(line_id), 1, 1)) - 1 AS d, substr(md5(line_id), 2, 2) = '00' AS long_one FROM ledger),
m AS (SELECT line_id, CASE WHEN d = 4 THEN 'two' ELSE name_raw END AS vendor_name, d <> 4 AS regular, CASE WHEN d = 2 THEN 2 WHEN d = 8 AND long_one THEN 1900 ELSE 0 END AS breaks,
 CASE WHEN d = 0 THEN '5" pipe' WHEN d = 1 THEN 'say "hi", twice' WHEN d = 2 THEN 'first' || chr(10) || 'second, "third"' || chr(10) WHEN d = 3 THEN '"Big "Bob" Henderson' WHEN d = 4 THEN 'one' WHEN d = 5 THEN 'say ""hi""' WHEN d = 6 THEN '' WHEN d = 7 THEN '12 inch"'
      WHEN d = 8 AND long_one THEN repeat('a line of text, with "quotes"' || chr(10), 1900) ELSE 'plain' END AS memo FROM q),
read AS (SELECT CAST(2 + coalesce(sum(1 + breaks) OVER (ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_no, line_id AS source_txn_id, trim(vendor_name) AS vendor_name, md5(memo) AS memo_md5, CAST(length(memo) AS BIGINT) AS memo_chars, regular FROM m)
"""
add("src3_records_with_quotes", _quoted, QUOTED_SQL + "SELECT * FROM read")
add("src4_gzipped_records", lambda b: _quoted(b, compression="gzip").groupBy("regular").agg(F.count(F.lit(1)).alias("n"), F.sum("line_no").alias("line_nos"), F.sum("memo_chars").alias("memo_chars"), F.min("memo_md5").alias("least_md5")), QUOTED_SQL + "SELECT regular, count(*) AS n, CAST(sum(line_no) AS BIGINT) AS line_nos, CAST(sum(memo_chars) AS BIGINT) AS memo_chars, min(memo_md5) AS least_md5 FROM read GROUP BY regular")
REASON_OF = "CASE e WHEN 0 THEN 'UNPARSEABLE_AMOUNT' WHEN 1 THEN 'UNPARSEABLE_DATE' WHEN 2 THEN 'UNKNOWN_CLIENT_REF' WHEN 3 THEN 'SUB_CENT_AMOUNT' WHEN 4 THEN 'MISSING_CLIENT_REF' WHEN 5 THEN 'UNSUPPORTED_CURRENCY' WHEN 6 THEN 'UNIDENTIFIABLE_VENDOR' ELSE 'RAGGED_ROW' END"
add("snk3_snk4_aborted_import", _aborted, DEFECT_SQL + f""", good AS (SELECT * FROM spoiled WHERE NOT (d = 0 AND e <= 7))
SELECT {REASON_OF} AS what, count(*) AS n, NULL::VARCHAR AS cents FROM spoiled WHERE d = 0 AND e <= 7 GROUP BY 1
UNION ALL SELECT 'live', count(*), CAST(CAST(sum(amount_cents) AS BIGINT) AS VARCHAR) FROM good
UNION ALL SELECT * FROM (VALUES ('run 1 RUNNING', 1, NULL), ('run 1 COMPLETED', 1, NULL), ('run 2 RUNNING', 1, NULL), ('run 2 FAILED', 1, NULL)) v""")
add("flt3_rejection_guard", _guard, DEFECT_SQL + "SELECT count(*) AS rows_read, count(*) FILTER (WHERE d = 0 AND e <= 7) AS rows_rejected FROM spoiled")
add("sec3_flt11_unguarded_tables", lambda b: b.spark.createDataFrame(R.catalog({"ledger": lambda: b.ledger, "filings": lambda: b.filings, "reason_code": lambda: reason_codes(b.spark)}, SHARED), "table_name string, has_firm boolean, is_shared boolean"),
    "SELECT * FROM (VALUES ('filings', true, false), ('ledger', true, false), ('reason_code', false, true)) v(table_name, has_firm, is_shared)", book=False)


def _run(b: Book) -> DataFrame:
    """Headers of a run that ends well and of one that does not; the phases' names stand for their timings, which differ from run to run."""
    with R.Run(b.spark, 1) as run:
        with run.phase("read"):
            run.count(read=b.ledger.count())
        with run.phase("live"):
            run.count(live=b.live.count())
    try:
        with R.Run(b.spark, 2) as bad, bad.phase("read"):
            raise ValueError
    except ValueError:
        pass
    phases = F.array_join(F.array_sort(F.map_keys(F.from_json("phases_ms", "map<string, long>"))), ",")
    return run.header().unionByName(bad.header()).select("run_id", "state", "counters", phases.alias("phases"))


add("snk7_run_header", _run, """SELECT 1 AS run_id, 'COMPLETED' AS state, '{"live": ' || (SELECT count(*) FROM live) || ', "read": ' || (SELECT count(*) FROM ledger) || '}' AS counters, 'live,read' AS phases UNION ALL SELECT 2, 'FAILED', '{}', 'read'""")
add("dml17_endpoint_books", lambda b: R.book_filings(R.book_submissions(b.work.filter("state <> 'SEALED'").select(F.col("batch_id").alias("idempotency_key"), F.lit("old").alias("source")), b.work.select(F.col("batch_id").alias("idempotency_key"), F.lit("new").alias("source"))), b.recorded.select(F.col("filing_id").alias("idempotency_key"), F.lit("filing").alias("source"))),
    "SELECT batch_id AS idempotency_key, CASE WHEN state <> 'SEALED' THEN 'old' ELSE 'new' END AS source FROM work UNION ALL SELECT filing_id, 'filing' FROM recorded")


def _cleared(b: Book) -> DataFrame:
    marks = b.dirty.withColumn("marked_at", F.col("client_id") % 4)
    return R.clear_dirty(marks, marks.filter(F.col("tax_year") == RULES.tax_year).select("firm_id", "client_id", "tax_year", F.lit(1).alias("watermark")))


add("dml19_watermark_clear", _cleared, ", marks AS (SELECT DISTINCT firm_id, client_id, tax_year FROM (SELECT firm_id, client_id, o_tax_year AS tax_year FROM changes WHERE change NOT IN ('unchanged', 'untouched') UNION SELECT firm_id, client_id, n_tax_year FROM changes WHERE change NOT IN ('unchanged', 'untouched')) x WHERE tax_year IS NOT NULL) SELECT firm_id, client_id, tax_year, client_id % 4 AS marked_at FROM marks WHERE NOT (tax_year = 1998 AND client_id % 4 <= 1)")

# -- scalars over the tables ---------------------------------------------------

INDEX_KEY, SEAL_KEYS = b"k" * 32, {1: b"0" * 16, 2: b"1" * 16}
DIGITS_SQL = "'1' || lpad(CAST(suppkey AS VARCHAR), 8, '0')"


def _digits():
    return F.concat(F.lit("1"), F.lpad(F.col("suppkey").cast("string"), 8, "0"))


def _hmac_sql(message: str) -> str:
    pad = lambda x: bytes(b ^ x for b in INDEX_KEY.ljust(64, b"\0")).hex()
    return f"sha256(unhex('{pad(0x5C)}') || unhex(sha256(unhex('{pad(0x36)}') || encode({message}))))"


def _vendors_of(b: Book) -> DataFrame:
    return b.ledger.select("firm_id", "client_id", "suppkey", "name_norm").distinct()


add("hsh3_hsh4_blind_indexes_of_the_book", lambda b: _vendors_of(b).select("firm_id", "suppkey", "name_norm").distinct().select("firm_id", "suppkey", S.tin_index(INDEX_KEY, F.col("firm_id"), _digits()).alias("tin_bidx"), S.name_index(INDEX_KEY, F.col("firm_id"), F.col("name_norm")).alias("name_bidx")),
    f"SELECT DISTINCT firm_id, suppkey, {_hmac_sql(f"firm_id || ':' || {DIGITS_SQL}")} AS tin_bidx, {_hmac_sql("firm_id || ':name:' || name_norm")} AS name_bidx FROM ledger")


def _sealed(b: Book) -> DataFrame:
    """Numbers sealed and opened again: under their own binding, under another's, and by who lacks the newest key."""
    aad = F.concat_ws(":", "firm_id", "client_id")
    sealed = _vendors_of(b).withColumn("digits", _digits()).withColumn("box", S.encrypt_tin(F.col("digits"), SEAL_KEYS, aad))
    own, other, old = S.decrypt_tin(F.col("box"), SEAL_KEYS, aad), S.decrypt_tin(F.col("box"), SEAL_KEYS, F.concat(aad, F.lit("x"))), S.decrypt_tin(F.col("box"), {1: SEAL_KEYS[1]}, aad)
    return sealed.groupBy("firm_id", F.col("box.key_version").alias("key_version")).agg(F.count(F.lit(1)).alias("sealed"), F.count(F.when(own == F.col("digits"), 1)).alias("opened"), F.count(other).alias("opened_elsewhere"), F.count(old).alias("opened_without_key"))


add("hsh5_sealed_numbers_of_the_book", _sealed, "SELECT firm_id, 2 AS key_version, count(*) AS sealed, count(*) AS opened, CAST(0 AS BIGINT) AS opened_elsewhere, CAST(0 AS BIGINT) AS opened_without_key FROM (SELECT DISTINCT firm_id, client_id, suppkey, name_norm FROM ledger) x GROUP BY firm_id")
add("hsh7_wire_content_hashes_of_the_book", lambda b: B.plan(b.decisions, F.concat(F.lit("10000"), F.col("tin_last4"))).select("firm_id", "filing_id", "content_hash"),
    "SELECT firm_id, filing_id, sha256('v1' || chr(31) || filing_id || chr(31) || '1' || chr(31) || '1998' || chr(31) || coalesce('10000' || tin_last4, '') || chr(31) || display_name || chr(31) || amount_cents || chr(31) || withholding_cents || chr(31)) AS content_hash FROM planned")
add("jsn2_canonical_json_of_the_book", lambda b: b.decisions.select("firm_id", "client_id", "vendor_key", S.canonical_json(F.create_map(F.lit("vendor"), F.concat("display_name", F.lit(' "x"')), F.lit("cents"), F.col("reportable_cents").cast("string"), F.lit("key"), F.col("vendor_key"))).alias("json")),
    """SELECT firm_id, client_id, vendor_key, '{"cents":"' || reportable_cents || '","key":"' || vendor_key || '","vendor":"' || display_name || ' \\"x\\""}' AS json FROM decided""")
add("str7_masked_numbers_of_the_book", lambda b: _vendors_of(b).select("suppkey").distinct().select("suppkey", S.tin_mask(F.when(F.col("suppkey") % 11 != 0, F.concat(F.lit("no "), F.substring(_digits(), F.lit(1), F.col("suppkey") % 10)))).alias("masked")),
    f"SELECT suppkey, CASE WHEN suppkey % 11 = 0 THEN NULL WHEN suppkey % 10 >= 4 THEN '***-**-' || right(substr({DIGITS_SQL}, 1, suppkey % 10), 4) ELSE '***' END AS masked FROM (SELECT DISTINCT suppkey FROM ledger) x")
add("num5_backoff_of_the_calls", lambda b: b.calls.withColumn("n", (F.col("call_id") % 9 + 1).cast("int")).select("call_id", S.backoff_ms(F.col("n")).alias("ms"), S.jittered_ms(S.backoff_ms(F.col("n")), S.hash_fraction(F.lit("seed"), F.col("call_id").cast("string"), F.col("n"))).alias("jittered")),
    """, b AS (SELECT call_id, CAST(least(60000, 1000 * pow(2, call_id % 9)) AS BIGINT) AS ms, sha256('seed|' || call_id || '|' || (call_id % 9 + 1)) AS h FROM calls)
SELECT call_id, ms, CAST(1 + floor(CAST(('0x' || substr(h, 1, 14)) AS UBIGINT) / 72057594037927936::DOUBLE * (greatest(ms, 2) - 1)) AS BIGINT) AS jittered FROM b""")


def _csv(b: Book) -> DataFrame:
    """The digest of a deterministic CSV of each client's totals."""
    totals = b.decisions.groupBy("firm_id", "client_id").agg(F.count(F.lit(1)).alias("vendors"), F.sum("reportable_cents").alias("cents"))
    where = scratch(b.spark, "csv")
    try:
        return b.spark.createDataFrame([(export.write_csv(totals, where, ["firm_id", "client_id"]),)], "sha256 string")
    finally:
        drop_scratch(b.spark, where)


add("snk5_deterministic_csv", _csv, "SELECT sha256('firm_id,client_id,vendors,cents' || chr(10) || string_agg(line || chr(10), '' ORDER BY firm_id, client_id)) AS sha256 FROM (SELECT firm_id, client_id, firm_id || ',' || client_id || ',' || count(*) || ',' || CAST(sum(reportable_cents) AS BIGINT) AS line FROM decided GROUP BY firm_id, client_id) x")


def _ack_attention(b: Book) -> DataFrame:
    """Of the batches with members that wait for an answer: what their acknowledgments raise."""
    waiting = b.members.join(b.filings.filter("state = 'SUBMITTED_UNACKNOWLEDGED'").select("firm_id", "filing_id"), ["firm_id", "filing_id"], "left_semi")
    asked = waiting.select("firm_id", "batch_id", F.col("filing_id").alias("_of"))
    acks = b.acks.withColumn("_of", F.regexp_replace("reference", "^x", "")).join(asked, ["firm_id", "_of"])
    return B.ack_attention(waiting, acks)


add("prj10_jn22_ack_attention", _ack_attention, """, wait AS (SELECT m.firm_id, m.batch_id, m.filing_id, m.client_id FROM members m JOIN filings f ON f.firm_id = m.firm_id AND f.filing_id = m.filing_id WHERE f.state = 'SUBMITTED_UNACKNOWLEDGED'),
asked AS (SELECT w.firm_id, w.batch_id, a.reference, a.outcome FROM acks a JOIN wait w ON w.firm_id = a.firm_id AND w.filing_id = regexp_replace(a.reference, '^x', '')),
j AS (SELECT coalesce(w.firm_id, k.firm_id) AS firm_id, coalesce(w.batch_id, k.batch_id) AS batch_id, w.client_id, w.filing_id, k.reference, k.outcome FROM wait w FULL OUTER JOIN asked k ON k.firm_id = w.firm_id AND k.batch_id = w.batch_id AND k.reference = w.filing_id),
g AS (SELECT firm_id, batch_id, max(client_id) AS client_id, count(*) FILTER (WHERE filing_id IS NULL) AS n_unexpected, count(*) FILTER (WHERE reference IS NULL) AS n_missing, count(reference) AS answers FROM j GROUP BY firm_id, batch_id)
SELECT 'ACK_RECONCILIATION_MISMATCH' AS type, 3 AS severity, 'BATCH' AS entity_type, batch_id AS entity_id, firm_id, client_id, n_unexpected, n_missing FROM g WHERE answers > 0 AND (n_unexpected > 0 OR n_missing > 0)
UNION ALL SELECT 'FILING_REJECTED', 3, 'FILING', filing_id, firm_id, client_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM j WHERE filing_id IS NOT NULL AND outcome = 'REJECTED'""")
