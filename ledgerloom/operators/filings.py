"""Filings, batches, acknowledgments, attention, rate windows, queue, invariants.

Every operator is a set query over snapshots with the clock as a parameter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import batch_key, fields_hash, uuid5

# States, what each may become, and what a reader is told of a filing that cannot go out.
MUTABLE = ("DRAFT", "READY_TO_TRANSMIT", "BLOCKED")
FROZEN = ("BATCHED", "SUBMITTED_UNACKNOWLEDGED")
FILING_TRANSITIONS = {
    "DRAFT": ("READY_TO_TRANSMIT", "BLOCKED"), "BLOCKED": ("READY_TO_TRANSMIT",), "READY_TO_TRANSMIT": ("BATCHED", "BLOCKED"),
    "BATCHED": ("SUBMITTED_UNACKNOWLEDGED", "READY_TO_TRANSMIT"), "SUBMITTED_UNACKNOWLEDGED": ("ACCEPTED", "REJECTED", "READY_TO_TRANSMIT"), "REJECTED": ("READY_TO_TRANSMIT",), "ACCEPTED": (),
}
BATCH_TRANSITIONS = {"SEALED": ("DISPATCHED", "VOID"), "DISPATCHED": ("SUBMITTED", "SEALED", "VOID"), "SUBMITTED": ("ACKNOWLEDGED", "VOID"), "ACKNOWLEDGED": (), "VOID": ()}


def preflight() -> tuple[Column, Column]:
    """(reason, attention type), null where the filing is ready; the first failure wins."""
    status, bad = F.col("tin_status"), "PREFLIGHT_VALIDATION_FAILED"
    checks = [
        (status != "PRESENT", F.concat(F.lit("no usable TIN ("), status, F.lit(")")), "VENDOR_MISSING_TIN"),
        (F.col("tin_bidx").isNull(), F.lit("TIN recorded as present but no ciphertext stored"), bad),
        (F.col("tin_last4").startswith("000"), F.lit("TIN begins 000"), bad),
        ((F.col("reportable_cents") <= 0) & (F.col("withholding_cents") <= 0), F.lit("non-positive reportable amount"), bad),
    ]
    reason, kind = F.when(F.lit(False), F.lit(None).cast("string")), F.when(F.lit(False), F.lit(None).cast("string"))
    for when, text, name in checks:
        reason, kind = reason.when(when, text), kind.when(when, F.lit(name))
    return reason, kind


def plan(decisions: DataFrame, number: Column | None = None, generation: Column | None = None) -> DataFrame:
    """One filing per required decision: name-based id, content hash, READY_TO_TRANSMIT or BLOCKED with reason.

    ``number`` is the number as it goes out on the wire, for the content hash (the
    blind index where a caller has no plaintext); ``generation`` counts from 1.
    """
    reason, kind = preflight()
    d = decisions.filter("form_required")
    d = d.withColumn("filing_id", uuid5(F.concat_ws("|", "firm_id", "client_id", "tax_year", "vendor_key")))
    d = d.withColumns({"block_reason": reason, "attention_type": kind, "generation": F.lit(1) if generation is None else generation})
    d = d.withColumn("content_hash", fields_hash(F.lit("v1"), F.col("filing_id"), F.col("generation"), F.col("tax_year"), F.coalesce(F.col("tin_bidx") if number is None else number, F.lit("")), F.col("display_name"), F.col("reportable_cents"), F.col("withholding_cents")))
    return d.select("filing_id", "firm_id", "client_id", "tax_year", "vendor_key", "generation", F.when(F.col("block_reason").isNull(), "READY_TO_TRANSMIT").otherwise("BLOCKED").alias("state"), "block_reason", "attention_type", "content_hash", F.col("reportable_cents").alias("amount_cents"), "withholding_cents", F.col("display_name").alias("recipient_name"))


def upsert(existing: DataFrame, planned: DataFrame) -> DataFrame:
    """(firm_id, filing_id, action, state, content_hash): insert, update, keep, or frozen / amended for filings past the point of change."""
    key = ["firm_id", "filing_id"]
    e = existing.select(*key, F.col("state").alias("e_state"), F.col("content_hash").alias("e_hash"))
    p = planned.select(*key, F.col("state").alias("p_state"), F.col("content_hash").alias("p_hash"))
    same = F.col("e_hash").eqNullSafe(F.col("p_hash"))
    open_ = F.col("e_state").isin(*MUTABLE)
    action = F.when(F.col("p_state").isNull(), "keep").when(F.col("e_state").isNull(), "insert").when(open_ & same & (F.col("e_state") == F.col("p_state")), "keep").when(open_, "update").when(same, "frozen").otherwise("amended")
    out = e.join(p, key, "full_outer").withColumn("action", action)
    take = F.col("action").isin("insert", "update")
    return out.select(*key, "action", F.when(take, F.col("p_state")).otherwise(F.col("e_state")).alias("state"), F.when(take, F.col("p_hash")).otherwise(F.col("e_hash")).alias("content_hash"))


def freeze_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Filings whose content changed while frozen, or whose accepted state moved; empty when all is well."""
    key = ["firm_id", "filing_id"]
    b = before.select(*key, F.col("state").alias("b_state"), F.col("content_hash").alias("b_hash"))
    j = b.join(after.select(*key, "state", "content_hash"), key)
    return j.filter((F.col("b_state").isin(*FROZEN) & ~F.col("b_hash").eqNullSafe(F.col("content_hash"))) | ((F.col("b_state") == "ACCEPTED") & (F.col("state") != "ACCEPTED"))).select(*key, "b_state", "state")


def bad_transitions(before: DataFrame, after: DataFrame, id_: str, table: dict[str, tuple[str, ...]]) -> DataFrame:
    allowed = F.lit(False)
    for a, to in table.items():
        allowed = allowed | ((F.col("from_state") == a) & F.col("to_state").isin(a, *to))
    j = before.select(id_, F.col("state").alias("from_state")).join(after.select(id_, F.col("state").alias("to_state")), id_)
    return j.filter(~allowed)


def seal(filings: DataFrame, size: int = 100) -> DataFrame:
    """Members (filing_id, firm_id, client_id, tax_year, generation, content_hash, batch_no) of batches of at most ``size`` filings of one client, in id order."""
    book = ["firm_id", "client_id", "tax_year"]
    own = filings.withColumn("_range", F.substring("filing_id", 1, 3))  # ids are ranked within ranges, so a large client is spread over many tasks
    before = Window.partitionBy(*book).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy(*book, "_range").agg(F.count(F.lit(1)).alias("_n")).select(*book, "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*book, "_range").orderBy("filing_id")) - 1
    ranked = own.withColumn("_rank", rank).join(counts, [*book, "_range"])
    return ranked.select("filing_id", *book, "generation", "content_hash", F.floor((F.col("_before") + F.col("_rank")) / size).cast("int").alias("batch_no"))


def batches(members: DataFrame) -> DataFrame:
    """One row per batch with the key derived from its content (at most ``size`` members are gathered)."""
    g = members.groupBy("firm_id", "client_id", "tax_year", "batch_no").agg(F.collect_list(F.struct(F.col("filing_id").alias("id"), "generation", "content_hash")).alias("m"))
    return g.select("firm_id", "client_id", "tax_year", "batch_no", F.size("m").alias("filing_count"), batch_key(F.col("firm_id"), F.col("client_id"), F.col("tax_year"), F.col("m")).alias("idempotency_key"))


def correlate(members: DataFrame, acks: DataFrame) -> DataFrame:
    """Acknowledgments to members by reference, never by position: MATCHED, MISSING (no ack) or UNEXPECTED (no member)."""
    key = ["firm_id", "filing_id"]
    m = members.select(*key, F.lit(True).alias("member"))
    a = acks.select("firm_id", F.col("reference").alias("filing_id"), "outcome", F.lit(True).alias("acked"))
    kind = F.when(F.col("acked").isNull(), "MISSING").when(F.col("member").isNull(), "UNEXPECTED").otherwise("MATCHED")
    return m.join(a, key, "full_outer").select(*key, kind.alias("kind"), "outcome")


def apply_acks(filings: DataFrame, correlated: DataFrame) -> DataFrame:
    """Filings' states after matched acknowledgments; those already decided are skipped, so applying twice changes nothing."""
    a = correlated.filter("kind = 'MATCHED'").select("firm_id", "filing_id", "outcome")
    return filings.join(a, ["firm_id", "filing_id"], "left").withColumn("state", F.when((F.col("state") == "SUBMITTED_UNACKNOWLEDGED") & F.col("outcome").isNotNull(), F.col("outcome")).otherwise(F.col("state"))).drop("outcome")


def ack_attention(members: DataFrame, acks: DataFrame) -> DataFrame:
    """What applying acknowledgments asks a reader to look at: a batch whose answers are not those of its members (ACK_RECONCILIATION_MISMATCH), and each rejected filing (FILING_REJECTED).

    ``members``: firm_id, batch_id, filing_id, client_id; ``acks``: firm_id,
    batch_id (that was asked about), reference, outcome. Returns type, severity,
    entity_type, entity_id, firm_id, client_id, n_unexpected, n_missing; a batch
    that was not answered at all is still waited for and raises nothing.
    """
    key = ["firm_id", "batch_id", "filing_id"]
    m = members.select(*key, "client_id", F.lit(True).alias("member"))
    a = acks.select("firm_id", "batch_id", F.col("reference").alias("filing_id"), "outcome", F.lit(True).alias("acked")).dropDuplicates(key)
    both = m.join(a, key, "full_outer")
    n = lambda when: F.count(F.when(when, 1))
    batches = both.groupBy("firm_id", "batch_id").agg(F.max("client_id").alias("client_id"), n(F.col("member").isNull()).alias("n_unexpected"), n(F.col("acked").isNull()).alias("n_missing"), F.count("acked").alias("_answers"))
    odd = batches.filter("_answers > 0 and (n_unexpected > 0 or n_missing > 0)").select(F.lit("ACK_RECONCILIATION_MISMATCH").alias("type"), F.lit(3).alias("severity"), F.lit("BATCH").alias("entity_type"), F.col("batch_id").alias("entity_id"), "firm_id", "client_id", "n_unexpected", "n_missing")
    zero = F.lit(0).cast("long")
    rejected = both.filter("member and outcome = 'REJECTED'").select(F.lit("FILING_REJECTED").alias("type"), F.lit(3).alias("severity"), F.lit("FILING").alias("entity_type"), F.col("filing_id").alias("entity_id"), "firm_id", "client_id", zero.alias("n_unexpected"), zero.alias("n_missing"))
    return odd.unionByName(rejected)


def ack_outcome() -> Column:
    """What the endpoint answers: rejection code or null for accepted."""
    return F.when(F.col("tin_bidx").isNull(), "R-TIN-FORMAT").when(F.col("tin_last4").startswith("000"), "R-TIN-PREFIX").when((F.col("amount_cents") <= 0) & (F.col("withholding_cents") <= 0), "R-AMOUNT")


def calls_in_window(calls: DataFrame, window_us: int) -> DataFrame:
    """Calls of the same firm within the window that ends with each call.

    Time is cut into stretches of a window's length; a call counts in its own and,
    as a guest, in the next one, so a firm with very many calls is spread over
    many tasks.
    """
    stretch = F.floor(F.col("at_us") / window_us)
    places = F.array(F.struct(stretch.alias("at"), F.lit(False).alias("guest")), F.struct((stretch + 1).alias("at"), F.lit(True).alias("guest")))
    w = Window.partitionBy("firm_id", "_place.at").orderBy("at_us").rangeBetween(-window_us, 0)
    return calls.withColumn("_place", F.explode(places)).withColumn("calls", F.count(F.lit(1)).over(w)).filter("not _place.guest").drop("_place")


def over_limit(calls: DataFrame, window_us: int, limit: int) -> DataFrame:
    return calls_in_window(calls, window_us).filter(F.col("calls") > limit)


def peak(calls: DataFrame, window_us: int) -> DataFrame:
    return calls_in_window(calls, window_us).groupBy("firm_id").agg(F.max("calls").alias("peak"))


def budget(calls: DataFrame, now_us: int, window_us: int, limit: int) -> DataFrame:
    """Used and remaining calls of each firm at an instant."""
    inside = (F.col("at_us") > now_us - window_us) & (F.col("at_us") <= now_us)
    used = F.count(F.when(inside, 1))
    return calls.groupBy("firm_id").agg(used.alias("used"), F.count(F.when(inside & (F.col("call_type") == "STATUS"), 1)).alias("polls"), F.greatest(F.lit(limit) - used, F.lit(0)).cast("long").alias("remaining"), F.max("at_us").alias("last_call"))


def safe_window_us(window_us: int, ratio: float = 0.02, floor_us: int = 250_000) -> int:
    """The promised window, widened by a share of it or by the floor, whichever is more: a call left out is then so old that no delay on the way brings it back into the endpoint's window."""
    return window_us + max(round(window_us * ratio), floor_us)


def admit(calls: DataFrame, window_us: int, limit: int) -> DataFrame:
    """Greedy sequential admission per firm: a call is granted while fewer than ``limit`` grants lie in the window before it (see ``safe_window_us``), and else told when the oldest of them leaves it.

    Whether a call is granted depends on all grants before it, so a firm's calls
    are read in order by one task; what that task holds is the last ``limit``
    grants, however many calls there are.
    """
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import deque

        firm, held = None, deque()
        for b in batches:
            granted, retry = [], []
            for f, t in zip(b.column("firm_id").to_pylist(), b.column("at_us").to_pylist(), strict=True):
                if f != firm:
                    firm, held = f, deque()
                while held and held[0] <= t - window_us:
                    held.popleft()
                granted.append(len(held) < limit)
                retry.append(None if granted[-1] else held[0] + window_us)
                if granted[-1]:
                    held.append(t)
            yield pa.RecordBatch.from_arrays([b.column("firm_id"), b.column("call_id"), pa.array(granted, pa.bool_()), pa.array(retry, pa.int64())], names=["firm_id", "call_id", "granted", "retry_at_us"])

    rows = calls.select(*[F.col(c).cast("long").alias(c) for c in ("firm_id", "call_id", "at_us")])
    return rows.repartition("firm_id").sortWithinPartitions("firm_id", "at_us", "call_id").mapInArrow(run, "firm_id long, call_id long, granted boolean, retry_at_us long")


def reserved_polls(limit: int, share: float) -> int:
    """How many of ``limit`` calls a window keeps for status polls."""
    return math.ceil(limit * share)


def claims(work: DataFrame, now_us: int, polls: Column, reserved: int) -> DataFrame:
    """Due batches with their class: reconcile 0, sealed 1, poll 2 (1 while fewer than the reserved polls were made)."""
    due = work.filter((F.col("next_action_us") <= now_us) & (F.col("lease_until_us").isNull() | (F.col("lease_until_us") < now_us)))
    a = due.filter("needs_reconcile").withColumn("cls", F.lit(0))
    b = due.filter("state = 'SEALED'").withColumn("cls", F.lit(1))
    c = due.filter("state in ('DISPATCHED', 'SUBMITTED') and not needs_reconcile").withColumn("cls", F.when(polls < reserved, 1).otherwise(2))
    return a.unionByName(b).unionByName(c)


def claim_next(work: DataFrame, now_us: int, polls: Column, reserved: int) -> DataFrame:
    return claims(work, now_us, polls, reserved).orderBy("cls", "next_action_us", "batch_id").limit(1)


def stuck(work: DataFrame, now_us: int, after_us: int) -> DataFrame:
    """Attention for batches past the threshold: indeterminate (1) or unacknowledged (4)."""
    late = work.filter((F.col("state").isin("DISPATCHED", "SUBMITTED")) & (F.col("next_action_us") < now_us - after_us))
    sent = F.col("state") == "DISPATCHED"
    return late.select("batch_id", F.when(sent, "SUBMISSION_INDETERMINATE_TOO_LONG").otherwise("SUBMISSION_UNACKNOWLEDGED_TOO_LONG").alias("type"), F.when(sent, 1).otherwise(4).alias("severity"))


def transition(work: DataFrame, evidence: DataFrame) -> DataFrame:
    """Batch states after evidence (batch_id, members, acked, absent): acknowledged when all are acked, void when proven absent, submitted on a receipt; the lease ends."""
    j = work.join(evidence, "batch_id", "left")
    state = F.when(F.col("absent"), "VOID").when(F.col("acked") >= F.col("members"), "ACKNOWLEDGED").when((F.col("state") == "DISPATCHED") & F.col("receipt"), "SUBMITTED").otherwise(F.col("state"))
    return j.select("batch_id", state.alias("state"), F.when(state == F.col("state"), F.col("lease_until_us")).alias("lease_until_us"))


def latest_attempts(log: DataFrame) -> DataFrame:
    """Append-only attempts: the latest outcome of each (a null outcome was never learned)."""
    return log.groupBy("attempt_id").agg(F.max_by(F.struct(*log.columns), F.struct("event_no")).alias("_last")).select("_last.*")


# -- the intent log: what is durably true wherever the process dies ------------

# What each event of a batch's log leaves behind (batch state, filing state, how a restart goes on).
AFTER_EVENT = {
    None: ("NONE", "READY_TO_TRANSMIT", "PLAN"), "SEAL": ("SEALED", "BATCHED", "DISPATCH"), "INTENT": ("DISPATCHED", "SUBMITTED_UNACKNOWLEDGED", "RECONCILE"), "UNKNOWN": ("DISPATCHED", "SUBMITTED_UNACKNOWLEDGED", "RECONCILE"),
    "RECEIPT": ("SUBMITTED", "SUBMITTED_UNACKNOWLEDGED", "POLL"), "FOUND": ("SUBMITTED", "SUBMITTED_UNACKNOWLEDGED", "POLL"), "ABSENT": ("VOID", "READY_TO_TRANSMIT", "PLAN"), "ACKS": ("SUBMITTED", "DECIDED", "POLL"), "SETTLE": ("ACKNOWLEDGED", "DECIDED", "NONE"),
}
#: The events that may follow one (None: the log's begin). A call is no event of the log: it may be made only between its intent and the outcome.
FOLLOWS = {None: ("SEAL",), "SEAL": ("INTENT",), "INTENT": ("UNKNOWN", "RECEIPT", "FOUND", "ABSENT"), "UNKNOWN": ("FOUND", "ABSENT"), "RECEIPT": ("ACKS",), "FOUND": ("ACKS",), "ABSENT": (), "ACKS": ("SETTLE",), "SETTLE": ()}


def replay(log: DataFrame) -> DataFrame:
    """What is true after every prefix of every batch's log, that is wherever a process can die, the empty prefix included.

    ``log``: firm_id, batch_id, seq (ascending within the batch), event (of
    ``AFTER_EVENT``, or CALL), arrived (of a CALL: whether it reached the endpoint,
    which no process can see). Returns firm_id, batch_id, position, event,
    batch_state, filing_state, recovery, endpoint_holds, legal (the event may follow
    the one before it, and a call has its intent before it) and safe (what recovery
    would send again the endpoint does not hold). An ordered fold by window, one
    pass for all prefixes; the state as of a position is the row of that position.
    """
    own = ["firm_id", "batch_id"]
    begin = log.select(*own).distinct().select(*own, F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("event"), F.lit(None).cast("boolean").alias("arrived"))
    rows = log.select(*own, F.col("seq").cast("long").alias("seq"), "event", "arrived").unionByName(begin)
    w = Window.partitionBy(*own).orderBy(F.col("seq").asc_nulls_first())
    so_far, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    durable = F.when(F.col("event") != "CALL", F.col("event"))
    at = rows.withColumns({
        "position": (F.row_number().over(w) - 1).cast("long"), "_now": F.last(durable, ignorenulls=True).over(so_far), "_was": F.last(durable, ignorenulls=True).over(before),
        "endpoint_holds": F.coalesce(F.bool_or((F.col("event") == "CALL") & F.col("arrived")).over(so_far), F.lit(False)),
    })
    value = lambda k: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for e, v in AFTER_EVENT.items() if e for x in (e, v[k])]), F.col("_now")), F.lit(AFTER_EVENT[None][k]))
    legal = F.col("event").isNull() | ((F.col("event") == "CALL") & F.col("_was").eqNullSafe(F.lit("INTENT")))
    for previous, events in FOLLOWS.items():
        if events:
            legal = legal | (F.col("_was").eqNullSafe(F.lit(previous)) & F.col("event").isin(*events))
    out = at.select(*own, "position", F.coalesce("event", F.lit("BEGIN")).alias("event"), value(0).alias("batch_state"), value(1).alias("filing_state"), value(2).alias("recovery"), "endpoint_holds", legal.alias("legal"))
    return out.withColumn("safe", ~(F.col("endpoint_holds") & F.col("recovery").isin("PLAN", "DISPATCH")))


# -- reconciliation of batches whose fate is not known --------------------------


def flag_ambiguous(work: DataFrame) -> DataFrame:
    """Batches that were sent without an answer ask for reconciliation."""
    return work.withColumn("needs_reconcile", F.col("needs_reconcile") | (F.col("state") == "DISPATCHED"))


def planning_waits(work: DataFrame) -> DataFrame:
    """(firm_id, planning_waits): no firm plans new batches while one of its own is unclear."""
    return flag_ambiguous(work).groupBy("firm_id").agg(F.bool_or("needs_reconcile").alias("planning_waits"))


def endpoint_status(work: DataFrame, members: DataFrame, recorded: DataFrame) -> DataFrame:
    """(batch_id, status) as the endpoint's books have it: UNKNOWN (never came), PENDING (in part), RESOLVED."""
    done = members.join(recorded.select("firm_id", "filing_id").distinct(), ["firm_id", "filing_id"], "left_semi").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n").isNull(), "UNKNOWN").when(F.col("n") < F.col("filing_count"), "PENDING").otherwise("RESOLVED")
    return work.join(done, "batch_id", "left").select("batch_id", status.alias("status"))


def may_release(attempts: DataFrame) -> DataFrame:
    """(batch_id, releasable): members may go back only if the one attempt made is known not to have reached the endpoint. ``attempts``: batch_id, attempt_no, sent (null: never learned)."""
    return attempts.groupBy("batch_id").agg(((F.max("attempt_no") == 1) & F.bool_and(F.coalesce(~F.col("sent"), F.lit(False)))).alias("releasable"))


def reconcile(work: DataFrame, status: DataFrame) -> DataFrame:
    """Flagged batches after the endpoint was asked: what never came is sealed again and sent anew, what it holds is submitted or acknowledged; the flag and the lease go. Other batches, and those already at their end, stay."""
    j = flag_ambiguous(work).join(status, "batch_id", "left")
    open_ = F.col("needs_reconcile") & F.col("state").isin("SEALED", "DISPATCHED", "SUBMITTED")
    state = F.when(open_ & (F.col("status") == "UNKNOWN") & (F.col("state") != "SUBMITTED"), "SEALED").when(open_ & (F.col("status") == "PENDING"), "SUBMITTED").when(open_ & (F.col("status") == "RESOLVED"), "ACKNOWLEDGED").otherwise(F.col("state"))
    asked = open_ & F.col("status").isNotNull()
    return j.select("batch_id", state.alias("state"), (F.col("needs_reconcile") & ~asked).alias("needs_reconcile"), F.when(~asked, F.col("lease_until_us")).alias("lease_until_us"))


# -- invariants: rows that violate them ---------------------------------------


def recorded_twice(recorded: DataFrame) -> DataFrame:
    return recorded.groupBy("firm_id", "filing_id", "generation").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")


def recorded_never_sent(recorded: DataFrame, filings: DataFrame) -> DataFrame:
    sent = filings.filter(F.col("state").isin("SUBMITTED_UNACKNOWLEDGED", "ACCEPTED", "REJECTED")).select("firm_id", "filing_id")
    return recorded.join(sent, ["firm_id", "filing_id"], "left_anti").select("firm_id", "filing_id").distinct()


def outcome_never_recorded(filings: DataFrame, recorded: DataFrame) -> DataFrame:
    return filings.filter(F.col("state").isin("ACCEPTED", "REJECTED")).join(recorded.select("firm_id", "filing_id"), ["firm_id", "filing_id"], "left_anti").select("firm_id", "filing_id", "state")


def unscheduled(filings: DataFrame, members: DataFrame, work: DataFrame, attention: DataFrame) -> DataFrame:
    """Filings neither terminal nor scheduled nor flagged."""
    key = ["firm_id", "filing_id"]
    waiting = filings.filter(~F.col("state").isin("ACCEPTED", "DRAFT", "READY_TO_TRANSMIT"))
    open_ = work.filter(F.col("state").isin("SEALED", "DISPATCHED", "SUBMITTED") & F.col("next_action_us").isNotNull())
    live = members.join(open_.select("firm_id", "batch_id"), ["firm_id", "batch_id"]).select(*key)
    flagged = attention.filter("resolved_at is null and entity_type = 'FILING'").select("firm_id", F.col("entity_id").alias("filing_id"))
    return waiting.join(live, key, "left_anti").join(flagged, key, "left_anti").select(*key, "state")


def disagreeing(filings: DataFrame, members: DataFrame, work: DataFrame) -> DataFrame:
    batches = work.select("firm_id", "batch_id", F.col("state").alias("batch_state"))
    j = batches.join(members.select("firm_id", "batch_id", "filing_id"), ["firm_id", "batch_id"]).join(filings.select("firm_id", "filing_id", F.col("state").alias("filing_state")), ["firm_id", "filing_id"])
    return j.filter("(batch_state = 'SEALED' and filing_state = 'SUBMITTED_UNACKNOWLEDGED') or (batch_state in ('DISPATCHED', 'SUBMITTED') and filing_state in ('READY_TO_TRANSMIT', 'BATCHED'))")


def unexplained(filings: DataFrame) -> DataFrame:
    return filings.filter("(state = 'ACCEPTED' and record_id is null) or (state = 'REJECTED' and reject_code is null)").select("filing_id", "state")


def misshapen(members: DataFrame, size: int) -> DataFrame:
    return members.groupBy("firm_id", "batch_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("client_id").alias("clients")).filter((F.col("n") > size) | (F.col("clients") > 1))


def orphans(members: DataFrame, work: DataFrame) -> DataFrame:
    own = ["firm_id", "batch_id"]
    return members.join(work.select(*own), own, "left_anti").select(*own, "filing_id")


def resubmitted(members: DataFrame) -> DataFrame:
    return members.groupBy("firm_id", "filing_id", "generation").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
