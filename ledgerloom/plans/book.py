"""The derived relations that the queries share, from the ledger of the test tables.

Filings' later life (states, batches, acknowledgments, books, attention) is read
off digits of a hash of their ids, so each engine derives the same book, with
some planted violations that the invariant queries must find.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import determine as D
from ..operators import filings as B
from ..operators import merge as M
from ..operators import upkeep as U
from ..operators import views as V
from ..rules import RuleSet
from ..session import drop_scratch, scratch, writing
from ..store import Store
from ..sources.testdata import LEDGER_SQL, aliases, ledger, table

RULES = RuleSet()
BATCH_SIZE = 20
NOW_US, LEASE_US = 1_900_000_000, 1_500_000_000
SCOPE = "o_tax_year BETWEEN 1996 AND 1998"
SNAP = ["firm_id", "client_id", "source_system", "source_txn_id", "tax_year", "amount_cents", "name_norm", "row_hash"]


def digit(c: str, n: int):
    return F.conv(F.substring(F.md5(F.col(c)), n, 1), 16, 10).cast("int")


#: Where a session has stored a relation of a directory's tables, and the tables' state it was made from.
_STORED: dict[tuple[str, str, str], tuple[str, str]] = {}


def listing(spark: SparkSession, directory: str) -> str:
    """A digest of the names, sizes and times of all files of a directory's tables: another one means that what was derived from them is out of date."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(directory)
    fs, seen = path.getFileSystem(sc._jsc.hadoopConfiguration()), []
    for status in fs.listStatus(path):
        inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        seen += [s.toString() for s in inner]  # path, length, time
    return hashlib.md5("\n".join(sorted(seen)).encode()).hexdigest()


class Book:
    """Lazily derived relations over one directory of tables.

    What an engine keeps between runs (decisions, filings, the dirty set, the merged
    snapshot, the store of snapshot and decisions by parts, the dashboard's counts)
    is written by the first query of a session that reads it and read from there by
    the others, as long as the tables' files are the same.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}
        self.spent: list[str] = []  # scratch folders that the next stored relation is made from

    @property
    def listing(self) -> str:
        return self._once("listing", lambda: listing(self.spark, self.sf_dir))

    @property
    def ledger(self) -> DataFrame:
        return self._once("ledger", lambda: ledger(self.spark, self.sf_dir))

    @property
    def live(self) -> DataFrame:
        return self._once("live", lambda: D.live(self.ledger))

    @property
    def aliases(self) -> DataFrame:
        return self._once("aliases", lambda: aliases(self.live))

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def place(self, name: str) -> tuple[str, bool]:
        """(folder, whether it is there already) of something kept for the session; what was made from other files of the tables is deleted."""
        key, sc = (self.spark.sparkContext.applicationId, self.sf_dir, name), self.spark.sparkContext
        where, made_from = _STORED.get(key, (None, None))
        if where is not None:
            path = sc._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
            if made_from == self.listing and path.getFileSystem(sc._jsc.hadoopConfiguration()).exists(path):
                return where, True
            drop_scratch(self.spark, where)
        where = scratch(self.spark, name)
        _STORED[key] = (where, self.listing)
        return where, False

    def stored(self, name: str, make) -> DataFrame:
        """The relation ``name``, written once in the session."""
        where, there = self.place(name)
        if not there:
            made = make()
            with writing(self.spark):
                made.write.parquet(where)
            while self.spent:
                drop_scratch(self.spark, self.spent.pop())
        return self.spark.read.parquet(where)

    def kept(self, name: str, fill) -> Store:
        """A store, filled once in the session."""
        where, there = self.place(name)
        store = Store(self.spark, where)
        if not there:
            fill(store)
            sc = self.spark.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(f"{where}/_SUCCESS")
            path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path).close()
        return store

    def store_all(self) -> None:
        """Writes what an engine keeps between runs, as a first import and determination would."""
        for name in ("stored_aliases", "decisions", "dirty", "snapshot", "filings", "state", "views"):
            getattr(self, name)

    @property
    def stored_aliases(self) -> DataFrame:
        return self._once("stored_aliases", lambda: self.stored("aliases", lambda: self.aliases))

    @property
    def state(self) -> Store:
        """Snapshot and decisions of all clients, cut by firm and bucket, as an import and a full determination leave them; nothing is dirty."""

        def fill(store: Store) -> None:
            with store.transaction() as t:
                t.replace("snapshot", U.cut(self.ledger), U.BY, salts=4)
                t.replace("decisions", U.cut(self.decisions), U.BY)
                t.replace("dirty", self.dirty.limit(0).withColumn("marked_at", F.lit(1)))

        return self._once("state", lambda: self.kept("state", fill))

    def source(self) -> DataFrame:
        """The live ledger as an import's rows."""
        rows = self.live.drop("deleted").withColumn("source_txn_id", F.col("line_id"))
        return rows.withColumn("row_hash", F.sha2(F.concat_ws("|", "line_id", "tax_year", "amount_cents", "name_norm"), 256))

    @property
    def imported(self) -> Store:
        """A store after two imports with a determination each: the first without some rows and with other amounts for some clients, the second with the ledger as it is."""

        def fill(store: Store) -> None:
            now, d = self.source(), digit("line_id", 1)
            before = now.filter((d != 1) | (F.col("client_id") % 3 != 0)).withColumn("amount_cents", F.when((d == 2) & (F.col("client_id") % 3 == 0), F.col("amount_cents") + 1).otherwise(F.col("amount_cents")))
            before = before.withColumn("row_hash", F.sha2(F.concat_ws("|", "line_id", "tax_year", "amount_cents", "name_norm"), 256))
            every = lambda prefix: F.lit(True)
            for run, source in enumerate((before, now), 1):
                U.apply_source(store, source, every, run)
                U.refresh_decisions(store, self.stored_aliases, RULES)
                store.vacuum()

        return self._once("imported", lambda: self.kept("imported", fill))

    @property
    def views(self) -> Store:
        """What the dashboard reads: counts and exceptions of the filings as planned, moved to their present state by deltas."""

        def fill(store: Store) -> None:
            year, severity = ["firm_id", "client_id", "tax_year"], ["firm_id", "client_id", "severity"]
            opened, raised = self.attention.withColumn("resolved_at", F.lit(None).cast("int")), D.exceptions(self.decisions)
            resolved, moves = self.attention.filter("resolved_at is not null"), U.status_moves(self.planned, self.filings)
            one = {"buckets": 1}  # a few rows a client: a firm is one part
            U.move_counts(store, "status", V.status_counts(self.planned), year, **one)
            U.move_counts(store, "attention", V.attention_counts(opened), severity, **one)
            U.refresh_exceptions(store, opened, raised, self.filings, **one)
            for half in (0, 1):
                U.move_counts(store, "status", U.status_deltas(moves.filter(F.col("client_id") % 2 == half)), year, **one)
            U.move_counts(store, "attention", U.attention_deltas(resolved.withColumn("sign", F.lit(-1))), severity, **one)
            U.refresh_exceptions(store, self.attention, raised, self.filings, resolved.select("firm_id", "client_id"), **one)

        return self._once("views", lambda: self.kept("views", fill))

    @property
    def decisions(self) -> DataFrame:
        """The stored result of the last full determination."""
        return self._once("decisions", lambda: self.stored("decisions", lambda: self.decided))

    @property
    def changes(self) -> DataFrame:
        return M.diff(self.old_snapshot, self.new_source, F.expr(SCOPE))

    @property
    def dirty(self) -> DataFrame:
        """The stored dirty set of the import."""
        return self._once("dirty", lambda: self.stored("dirty", lambda: M.dirty_units(self.changes)))

    @property
    def snapshot(self) -> DataFrame:
        """The stored snapshot after the import."""
        return self._once("snapshot", lambda: self.stored("snapshot", lambda: M.merged(self.changes, SNAP)))

    @property
    def classified(self) -> DataFrame:
        return self._once("classified", lambda: D.determine(self.ledger, self.aliases, RULES)[0])

    @property
    def decided(self) -> DataFrame:
        return self._once("decided", lambda: D.decide(D.decompose(self.classified, RULES), RULES))

    @property
    def planned(self) -> DataFrame:
        return self._once("planned", lambda: B.plan(self.decisions))

    @property
    def filings(self) -> DataFrame:
        def make():
            d, e = digit("filing_id", 1), digit("filing_id", 2)
            state = F.when(F.col("state") == "BLOCKED", "BLOCKED").when(d < 8, "ACCEPTED").when(d < 10, "REJECTED").when(d < 12, "SUBMITTED_UNACKNOWLEDGED").when(d < 14, "BATCHED").otherwise("READY_TO_TRANSMIT")
            f = self.planned.withColumn("state", state)
            return f.withColumns({"record_id": F.when((F.col("state") == "ACCEPTED") & (e != 0), F.concat(F.lit("REC-"), F.substring(F.md5("filing_id"), 3, 8))), "reject_code": F.when((F.col("state") == "REJECTED") & (e != 0), "R-AMOUNT")})

        return self._once("filings", lambda: self.stored("filings", make))

    @property
    def members(self) -> DataFrame:
        def make():
            m = B.seal(self.filings.filter(~F.col("state").isin("BLOCKED", "READY_TO_TRANSMIT")), BATCH_SIZE)
            return m.withColumn("batch_id", F.concat_ws("-", "firm_id", "client_id", "batch_no"))

        return self._once("members", make)

    @property
    def work(self) -> DataFrame:
        def make():
            b = self.members.groupBy("batch_id", "firm_id", "client_id").agg(F.count(F.lit(1)).alias("filing_count"))
            d = digit("batch_id", 1)
            return b.select(
                "batch_id", "firm_id", "client_id", "filing_count", F.when(d < 4, "SEALED").when(d < 7, "DISPATCHED").when(d < 10, "SUBMITTED").when(d < 14, "ACKNOWLEDGED").otherwise("VOID").alias("state"),
                (digit("batch_id", 2) < 4).alias("needs_reconcile"), (F.lit(1_000_000_000) + digit("batch_id", 3).cast("long") * 100_000_000).alias("next_action_us"), F.when(digit("batch_id", 4) >= 8, F.lit(LEASE_US) + (digit("batch_id", 4) % 3).cast("long") * 300_000_000).alias("lease_until_us"),
            )

        return self._once("work", make)

    @property
    def recorded(self) -> DataFrame:
        def make():
            m = self.members.join(self.filings.select("filing_id", "state"), "filing_id").withColumn("e", digit("filing_id", 2))
            cols = ["firm_id", "filing_id", "generation"]
            done = m.filter("state in ('ACCEPTED', 'REJECTED') and e <> 1")
            return done.select(*cols).unionByName(done.filter("e = 2").select(*cols)).unionByName(m.filter("state = 'BATCHED' and e = 3").select(*cols))

        return self._once("recorded", make)

    @property
    def acks(self) -> DataFrame:
        def make():
            s = self.filings.filter("state = 'SUBMITTED_UNACKNOWLEDGED'").withColumn("e", digit("filing_id", 2))
            out = F.when(F.col("e") % 2 == 0, "ACCEPTED").otherwise("REJECTED").alias("outcome")
            return s.filter("e < 8").select("firm_id", F.col("filing_id").alias("reference"), out).unionByName(s.filter("e = 8").select("firm_id", F.concat(F.lit("x"), "filing_id").alias("reference"), out))

        return self._once("acks", make)

    @property
    def attention(self) -> DataFrame:
        def make():
            e = digit("filing_id", 2)
            f = self.filings.withColumn("e", e)
            cols = [F.lit("FILING").alias("entity_type"), F.col("filing_id").alias("entity_id"), "firm_id", "client_id", F.when(F.col("e") == 4, 1).alias("resolved_at")]
            a = f.filter("state = 'BLOCKED'").select(F.col("attention_type").alias("type"), F.lit(5).alias("severity"), *cols)
            return a.unionByName(f.filter("state = 'REJECTED' and e <> 5").select(F.lit("FILING_REJECTED").alias("type"), F.lit(3).alias("severity"), *cols))

        return self._once("attention", make)

    @property
    def calls(self) -> DataFrame:
        e = table(self.spark, self.sf_dir, "events")
        return e.select((F.col("user_id")).alias("firm_id"), F.col("event_id").alias("call_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.when(F.col("event_id") % 3 == 0, "STATUS").otherwise("SUBMIT").alias("call_type"))

    def _slice(self) -> DataFrame:
        v = self.ledger.select("firm_id", "client_id", "source_system", F.col("line_id").alias("source_txn_id"), "tax_year", "amount_cents", "name_norm")
        return v.withColumn("d", digit("source_txn_id", 1))

    @staticmethod
    def _hashed(df: DataFrame) -> DataFrame:
        return df.withColumn("row_hash", F.sha2(F.concat_ws("|", "source_txn_id", "tax_year", "amount_cents", "name_norm"), 256)).drop("d")

    @property
    def old_snapshot(self) -> DataFrame:
        s = self._slice().filter("d <> 0")
        return self._hashed(s.withColumn("deleted", F.col("d") == 3))

    @property
    def new_source(self) -> DataFrame:
        return self._hashed(self._slice().filter("d <> 1").withColumn("amount_cents", F.when(F.col("d") == 2, F.col("amount_cents") + 1).otherwise(F.col("amount_cents"))))

    @property
    def rejections(self) -> DataFrame:
        """Rejected import rows, off the events: file by user, reason by type, three runs."""
        e = table(self.spark, self.sf_dir, "events")
        return e.select((F.col("event_id") % 3).cast("int").alias("run_id"), F.concat(F.lit("payments-"), (F.col("user_id") % 4).cast("string"), F.lit(".csv")).alias("file_name"), F.col("event_id").alias("line_no"), F.upper("event_type").alias("reason_code"))


BOOK_SQL = f"""WITH {LEDGER_SQL},
names AS (SELECT firm_id, client_id, name_norm, count(DISTINCT tin_bidx) AS n_tins, min(tin_bidx) AS only_tin FROM live WHERE tax_year = 1998 GROUP BY firm_id, client_id, name_norm),
resolved AS (
 SELECT l.*, n.n_tins, n.only_tin,
  coalesce(a.canonical_key, 'TIN:' || l.tin_bidx, CASE WHEN n.n_tins = 1 THEN 'TIN:' || n.only_tin END, 'NAME:' || l.name_norm) AS vendor_key,
  CASE WHEN a.canonical_key IS NOT NULL THEN 'MANUAL_ALIAS' WHEN l.tin_bidx IS NOT NULL THEN 'DIRECT_TIN' WHEN n.n_tins = 1 THEN 'NAME_TIN_PROMOTION' WHEN n.n_tins > 1 THEN 'AMBIGUOUS_NAME_MULTI_TIN' ELSE 'NAME_ONLY' END AS identity_source
 FROM live l LEFT JOIN names n ON l.firm_id = n.firm_id AND l.client_id = n.client_id AND l.name_norm = n.name_norm
 LEFT JOIN alias a ON l.firm_id = a.firm_id AND l.client_id = a.client_id AND 'NAME:' || l.name_norm = a.alias_key),
classified AS (
 SELECT *, CASE WHEN disposition IN ('COUNTED', 'COUNTED_REVERSAL') THEN amount_cents ELSE 0 END AS counted_cents FROM (
  SELECT *, CASE WHEN tax_year <> 1998 THEN 'EXCLUDED_OUT_OF_TAX_YEAR' WHEN entry_type = 'VOID' THEN 'EXCLUDED_VOID' WHEN expense_class <> 'SERVICES' THEN 'EXCLUDED_NON_SERVICES'
   WHEN is_card THEN 'EXCLUDED_CARD_TPSO' WHEN amount_cents = 0 AND withholding_cents = 0 THEN 'EXCLUDED_ZERO_AMOUNT' WHEN amount_cents < 0 THEN 'COUNTED_REVERSAL' ELSE 'COUNTED' END AS disposition FROM resolved) x),
decomposed AS (
 SELECT firm_id, client_id, vendor_key, min(name_raw) AS display_name, max(tin_bidx) AS tin_bidx, max(tin_last4) AS tin_last4, max(tin_status) AS tin_status, max(identity_source) AS identity_source,
  CAST(coalesce(sum(amount_cents) FILTER (WHERE tax_year = 1998 AND amount_cents > 0), 0) AS BIGINT) AS gross_cents,
  CAST(coalesce(sum(amount_cents) FILTER (WHERE disposition = 'EXCLUDED_CARD_TPSO' AND amount_cents > 0), 0) AS BIGINT) AS card_excluded_cents,
  CAST(coalesce(sum(-amount_cents) FILTER (WHERE disposition = 'COUNTED_REVERSAL'), 0) AS BIGINT) AS reversal_cents,
  CAST(coalesce(sum(amount_cents) FILTER (WHERE disposition = 'EXCLUDED_NON_SERVICES' AND amount_cents > 0), 0) AS BIGINT) AS non_services_cents,
  CAST(coalesce(sum(amount_cents) FILTER (WHERE disposition = 'EXCLUDED_OUT_OF_TAX_YEAR' AND amount_cents > 0), 0) AS BIGINT) AS out_of_year_cents,
  CAST(sum(counted_cents) AS BIGINT) AS reportable_cents,
  CAST(coalesce(sum(withholding_cents) FILTER (WHERE tax_year = 1998 AND NOT is_card), 0) AS BIGINT) AS withholding_cents,
  count(*) FILTER (WHERE disposition IN ('COUNTED', 'COUNTED_REVERSAL')) AS counted_count, count(*) AS total_count, bool_or(tin_status <> 'PRESENT') AS any_tin_problem
 FROM classified GROUP BY firm_id, client_id, vendor_key),
decided AS (
 SELECT *, reportable_cents >= 6000000 OR withholding_cents > 0 AS form_required,
  CASE WHEN reportable_cents >= 6000000 THEN 'THRESHOLD_MET' WHEN withholding_cents > 0 THEN 'BACKUP_WITHHOLDING' ELSE 'BELOW_THRESHOLD' END AS requirement_reason,
  (reportable_cents >= 6000000 OR withholding_cents > 0) AND any_tin_problem AS transmit_blocked, 1998 AS tax_year FROM decomposed),
raised AS (
 SELECT firm_id, client_id, vendor_key, tax_year, 'MISSING_TIN' AS code, 'BLOCKING' AS severity, display_name, reportable_cents FROM decided WHERE form_required AND tin_status = 'MISSING'
 UNION ALL SELECT firm_id, client_id, vendor_key, tax_year, 'MALFORMED_TIN', 'BLOCKING', display_name, reportable_cents FROM decided WHERE form_required AND tin_status = 'MALFORMED'
 UNION ALL SELECT firm_id, client_id, vendor_key, tax_year, 'AMBIGUOUS_VENDOR_IDENTITY', 'REVIEW', display_name, reportable_cents FROM decided WHERE identity_source = 'AMBIGUOUS_NAME_MULTI_TIN'
 UNION ALL SELECT firm_id, client_id, vendor_key, tax_year, 'NEGATIVE_REPORTABLE', 'REVIEW', display_name, reportable_cents FROM decided WHERE reportable_cents < 0),
u AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(firm_id || '|' || client_id || '|' || tax_year || '|' || vendor_key)) AS h FROM decided WHERE form_required),
planned AS (
 SELECT *, sha256('v1' || chr(31) || filing_id || chr(31) || '1' || chr(31) || '1998' || chr(31) || coalesce(tin_bidx, '') || chr(31) || display_name || chr(31) || amount_cents || chr(31) || withholding_cents || chr(31)) AS content_hash,
  CASE WHEN block_reason IS NULL THEN 'READY_TO_TRANSMIT' ELSE 'BLOCKED' END AS state FROM (
  SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS filing_id,
   firm_id, client_id, tax_year, vendor_key, 1 AS generation, tin_bidx, tin_last4, reportable_cents AS amount_cents, withholding_cents, display_name, display_name AS recipient_name,
   CASE WHEN tin_status <> 'PRESENT' THEN 'no usable TIN (' || tin_status || ')' WHEN tin_bidx IS NULL THEN 'TIN recorded as present but no ciphertext stored' WHEN starts_with(tin_last4, '000') THEN 'TIN begins 000'
        WHEN reportable_cents <= 0 AND withholding_cents <= 0 THEN 'non-positive reportable amount' END AS block_reason,
   CASE WHEN tin_status <> 'PRESENT' THEN 'VENDOR_MISSING_TIN' WHEN tin_bidx IS NULL OR starts_with(tin_last4, '000') OR (reportable_cents <= 0 AND withholding_cents <= 0) THEN 'PREFLIGHT_VALIDATION_FAILED' END AS attention_type
  FROM u) x),
digits AS (SELECT *, strpos('0123456789abcdef', substr(md5(filing_id), 1, 1)) - 1 AS d, strpos('0123456789abcdef', substr(md5(filing_id), 2, 1)) - 1 AS e FROM planned),
filings0 AS (SELECT * REPLACE (CASE WHEN state = 'BLOCKED' THEN 'BLOCKED' WHEN d < 8 THEN 'ACCEPTED' WHEN d < 10 THEN 'REJECTED' WHEN d < 12 THEN 'SUBMITTED_UNACKNOWLEDGED' WHEN d < 14 THEN 'BATCHED' ELSE 'READY_TO_TRANSMIT' END AS state) FROM digits),
filings AS (SELECT *, CASE WHEN state = 'ACCEPTED' AND e <> 0 THEN 'REC-' || substr(md5(filing_id), 3, 8) END AS record_id, CASE WHEN state = 'REJECTED' AND e <> 0 THEN 'R-AMOUNT' END AS reject_code FROM filings0),
members AS (SELECT filing_id, firm_id, client_id, tax_year, generation, content_hash, batch_no, firm_id || '-' || client_id || '-' || batch_no AS batch_id FROM (
 SELECT *, CAST((row_number() OVER (PARTITION BY firm_id, client_id, tax_year ORDER BY filing_id) - 1) // 20 AS INTEGER) AS batch_no FROM filings WHERE state NOT IN ('BLOCKED', 'READY_TO_TRANSMIT')) x),
work0 AS (SELECT batch_id, firm_id, client_id, count(*) AS filing_count, [strpos('0123456789abcdef', substr(md5(batch_id), i, 1)) - 1 for i in [1, 2, 3, 4]] AS x FROM members GROUP BY batch_id, firm_id, client_id),
work AS (SELECT batch_id, firm_id, client_id, filing_count, CASE WHEN x[1] < 4 THEN 'SEALED' WHEN x[1] < 7 THEN 'DISPATCHED' WHEN x[1] < 10 THEN 'SUBMITTED' WHEN x[1] < 14 THEN 'ACKNOWLEDGED' ELSE 'VOID' END AS state,
 x[2] < 4 AS needs_reconcile, CAST(1000000000 + x[3] * 100000000 AS BIGINT) AS next_action_us, CASE WHEN x[4] >= 8 THEN CAST(1500000000 + 300000000 * (x[4] % 3) AS BIGINT) END AS lease_until_us FROM work0),
done AS (SELECT m.firm_id, m.filing_id, m.generation, f.state, f.e FROM members m JOIN filings f ON m.filing_id = f.filing_id),
recorded AS (SELECT firm_id, filing_id, generation FROM done WHERE state IN ('ACCEPTED', 'REJECTED') AND e <> 1 UNION ALL SELECT firm_id, filing_id, generation FROM done WHERE state IN ('ACCEPTED', 'REJECTED') AND e = 2
 UNION ALL SELECT firm_id, filing_id, generation FROM done WHERE state = 'BATCHED' AND e = 3),
acks AS (SELECT firm_id, CASE WHEN e = 8 THEN 'x' || filing_id ELSE filing_id END AS reference, CASE WHEN e % 2 = 0 THEN 'ACCEPTED' ELSE 'REJECTED' END AS outcome FROM filings WHERE state = 'SUBMITTED_UNACKNOWLEDGED' AND e <= 8),
attention AS (SELECT attention_type AS type, 5 AS severity, 'FILING' AS entity_type, filing_id AS entity_id, firm_id, client_id, CASE WHEN e = 4 THEN 1 END AS resolved_at FROM filings WHERE state = 'BLOCKED'
 UNION ALL SELECT 'FILING_REJECTED', 3, 'FILING', filing_id, firm_id, client_id, CASE WHEN e = 4 THEN 1 END FROM filings WHERE state = 'REJECTED' AND e <> 5),
calls AS (SELECT user_id AS firm_id, event_id AS call_id, epoch_us(ts) AS at_us, CASE WHEN event_id % 3 = 0 THEN 'STATUS' ELSE 'SUBMIT' END AS call_type FROM events),
slice AS (SELECT firm_id, client_id, source_system, line_id AS source_txn_id, tax_year, amount_cents, name_norm, strpos('0123456789abcdef', substr(md5(line_id), 1, 1)) - 1 AS d FROM ledger),
old_snapshot AS (SELECT *, sha256(source_txn_id || '|' || tax_year || '|' || amount_cents || '|' || name_norm) AS row_hash, d = 3 AS deleted FROM slice WHERE d <> 0),
new_source AS (SELECT *, sha256(source_txn_id || '|' || tax_year || '|' || amount_cents || '|' || name_norm) AS row_hash FROM (SELECT * REPLACE (CASE WHEN d = 2 THEN amount_cents + 1 ELSE amount_cents END AS amount_cents) FROM slice WHERE d <> 1) x),
changes AS (SELECT coalesce(o.firm_id, n.firm_id) AS firm_id, coalesce(o.client_id, n.client_id) AS client_id, coalesce(o.source_system, n.source_system) AS source_system, coalesce(o.source_txn_id, n.source_txn_id) AS source_txn_id,
  o.tax_year AS o_tax_year, n.tax_year AS n_tax_year, o.row_hash AS o_row_hash, n.row_hash AS n_row_hash, o.deleted AS o_deleted, o.amount_cents AS o_amount_cents, n.amount_cents AS n_amount_cents, o.name_norm AS o_name_norm, n.name_norm AS n_name_norm,
  CASE WHEN o.row_hash IS NULL THEN 'inserted' WHEN n.row_hash IS NULL AND NOT o.deleted AND o.tax_year BETWEEN 1996 AND 1998 THEN 'tombstoned' WHEN n.row_hash IS NULL THEN 'untouched'
       WHEN o.deleted THEN 'resurrected' WHEN o.row_hash IS DISTINCT FROM n.row_hash THEN 'updated' ELSE 'unchanged' END AS change
 FROM old_snapshot o FULL OUTER JOIN new_source n ON o.firm_id = n.firm_id AND o.client_id = n.client_id AND o.source_system = n.source_system AND o.source_txn_id = n.source_txn_id),
rejections AS (SELECT CAST(event_id % 3 AS INTEGER) AS run_id, 'payments-' || (user_id % 4) || '.csv' AS file_name, event_id AS line_no, upper(event_type) AS reason_code FROM events)
"""
