"""Determination: identity resolution, ordered classification, decomposition, decision, exceptions.

The chain over payments is scan, one small aggregation of name identities, two
left joins and one aggregation by vendor. Everything is an expression over the
same rows, so totals and reasons cannot disagree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import RuleSet

KEY = ["firm_id", "client_id", "vendor_key"]


def disposition(rules: RuleSet) -> Column:
    """The first rule that matches; the order is the precedence."""
    return (
        F.when(F.col("tax_year") != rules.tax_year, "EXCLUDED_OUT_OF_TAX_YEAR")
        .when(F.col("entry_type") == "VOID", "EXCLUDED_VOID")
        .when(F.col("expense_class") != "SERVICES", "EXCLUDED_NON_SERVICES")
        .when(F.col("is_card"), "EXCLUDED_CARD_TPSO")
        .when((F.col("amount_cents") == 0) & (F.col("withholding_cents") == 0), "EXCLUDED_ZERO_AMOUNT")
        .when(F.col("amount_cents") < 0, "COUNTED_REVERSAL")
        .otherwise("COUNTED")
    )


def counted() -> Column:
    return F.col("disposition").isin("COUNTED", "COUNTED_REVERSAL")


def live(lines: DataFrame) -> DataFrame:
    return lines.filter(~F.col("deleted"))


def name_identities(lines: DataFrame, rules: RuleSet) -> DataFrame:
    """(firm, client, name): how many numbers stand behind a name in the year, and the only one."""
    return lines.filter(F.col("tax_year") == rules.tax_year).groupBy("firm_id", "client_id", "name_norm").agg(F.count_distinct("tin_bidx").alias("n_tins"), F.min("tin_bidx").alias("only_tin"))


def resolve(lines: DataFrame, aliases: DataFrame, rules: RuleSet) -> DataFrame:
    """Add vendor_key and identity_source: alias, own number, the one number of the name, else the name."""
    names = name_identities(lines, rules)
    own_key = F.concat(F.lit("NAME:"), F.col("name_norm"))
    out = lines.join(names, ["firm_id", "client_id", "name_norm"], "left").withColumn("alias_key", own_key).join(aliases, ["firm_id", "client_id", "alias_key"], "left")
    key = F.coalesce("canonical_key", F.concat(F.lit("TIN:"), "tin_bidx"), F.when(F.col("n_tins") == 1, F.concat(F.lit("TIN:"), "only_tin")), "alias_key")
    source = F.when(F.col("canonical_key").isNotNull(), "MANUAL_ALIAS").when(F.col("tin_bidx").isNotNull(), "DIRECT_TIN").when(F.col("n_tins") == 1, "NAME_TIN_PROMOTION").when(F.col("n_tins") > 1, "AMBIGUOUS_NAME_MULTI_TIN").otherwise("NAME_ONLY")
    return out.withColumns({"vendor_key": key, "identity_source": source}).drop("alias_key", "canonical_key")


def classify(resolved: DataFrame, rules: RuleSet) -> DataFrame:
    out = resolved.withColumn("disposition", disposition(rules))
    return out.withColumn("counted_cents", F.when(counted(), F.col("amount_cents")).otherwise(F.lit(0)).cast("long"))


def decompose(classified: DataFrame, rules: RuleSet) -> DataFrame:
    """One pass per vendor: money buckets, counts, representative attributes."""
    amount, positive, year = F.col("amount_cents"), F.col("amount_cents") > 0, F.col("tax_year") == rules.tax_year

    def total(when: Column, value: Column = amount) -> Column:
        return F.coalesce(F.sum(F.when(when, value)), F.lit(0)).cast("long")

    def bucket(name: str) -> Column:
        return total((F.col("disposition") == name) & positive)

    return classified.groupBy(*KEY).agg(
        F.min("name_raw").alias("display_name"), F.max("tin_bidx").alias("tin_bidx"), F.max("tin_last4").alias("tin_last4"), F.max("tin_status").alias("tin_status"), F.max("identity_source").alias("identity_source"),
        total(year & positive).alias("gross_cents"), bucket("EXCLUDED_CARD_TPSO").alias("card_excluded_cents"),
        total(F.col("disposition") == "COUNTED_REVERSAL", -amount).alias("reversal_cents"),
        bucket("EXCLUDED_NON_SERVICES").alias("non_services_cents"), bucket("EXCLUDED_OUT_OF_TAX_YEAR").alias("out_of_year_cents"),
        F.sum("counted_cents").alias("reportable_cents"), total(year & ~F.col("is_card"), F.col("withholding_cents")).alias("withholding_cents"),
        F.count(F.when(counted(), 1)).alias("counted_count"), F.count(F.lit(1)).alias("total_count"),
        F.bool_or(F.col("tin_status") != "PRESENT").alias("any_tin_problem"),
    )


def decide(decomposed: DataFrame, rules: RuleSet) -> DataFrame:
    """form_required (threshold inclusive), its reason, and whether transmission is blocked."""
    met, held = F.col("reportable_cents") >= rules.threshold_cents, F.col("withholding_cents") > 0
    return decomposed.withColumns({
        "form_required": met | held,
        "requirement_reason": F.when(met, "THRESHOLD_MET").when(held, "BACKUP_WITHHOLDING").otherwise("BELOW_THRESHOLD"),
        "transmit_blocked": (met | held) & F.col("any_tin_problem"),
        "tax_year": F.lit(rules.tax_year),
    })


def determine(lines: DataFrame, aliases: DataFrame, rules: RuleSet) -> tuple[DataFrame, DataFrame]:
    """(classified payments, vendor decisions)."""
    work = classify(resolve(live(lines), aliases, rules), rules)
    return work, decide(decompose(work, rules), rules)


def incremental(lines: DataFrame, aliases: DataFrame, rules: RuleSet, dirty: DataFrame, previous: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Decisions after recomputing only the dirty (firm, client) of the rule year; the others are carried over from ``previous``, the stored decisions. A dirty client without live rows loses its decisions.

    ``dirty`` should be a stored table: it is read twice. Where it is small it is
    sent to the executors, so lines stored by client are pruned to its clients.
    """
    scope = dirty.filter(F.col("tax_year") == rules.tax_year).select("firm_id", "client_id").distinct()
    scope = F.broadcast(scope) if scope.count() <= broadcast_rows else scope
    part = lines.join(scope, ["firm_id", "client_id"], "left_semi")
    return previous.join(scope, ["firm_id", "client_id"], "left_anti").unionByName(determine(part, aliases, rules)[1])


def exceptions(decisions: DataFrame) -> DataFrame:
    """One row per (vendor, code): one scan, the codes that hold are exploded."""
    d = F.col
    raised = F.filter(F.array(
        F.when(d("form_required") & (d("tin_status") == "MISSING"), F.struct(F.lit("MISSING_TIN").alias("code"), F.lit("BLOCKING").alias("severity"))),
        F.when(d("form_required") & (d("tin_status") == "MALFORMED"), F.struct(F.lit("MALFORMED_TIN").alias("code"), F.lit("BLOCKING").alias("severity"))),
        F.when(d("identity_source") == "AMBIGUOUS_NAME_MULTI_TIN", F.struct(F.lit("AMBIGUOUS_VENDOR_IDENTITY").alias("code"), F.lit("REVIEW").alias("severity"))),
        F.when(d("reportable_cents") < 0, F.struct(F.lit("NEGATIVE_REPORTABLE").alias("code"), F.lit("REVIEW").alias("severity"))),
    ), lambda x: x.isNotNull())
    detail = F.to_json(F.struct(F.col("display_name").alias("displayName"), F.col("reportable_cents").alias("reportableCents")))
    return decisions.select(*KEY, "tax_year", detail.alias("detail"), F.explode(raised).alias("x")).select(*KEY, "tax_year", "x.code", "x.severity", "detail")


def explanations(classified: DataFrame, reasons: DataFrame) -> DataFrame:
    """Payment evidence with its human reason."""
    return classified.join(reasons, F.col("disposition") == F.col("code"), "left").select(*KEY, "line_id", "identity_source", "disposition", "counted_cents", "human_text")


def unreconciled(classified: DataFrame, decisions: DataFrame) -> DataFrame:
    """Vendors whose explained cents differ from the decided total; empty when all is well."""
    sums = classified.groupBy(*KEY).agg(F.sum("counted_cents").alias("explained"))
    return decisions.join(sums, KEY, "left").filter(~F.col("explained").eqNullSafe(F.col("reportable_cents"))).select(*KEY, "reportable_cents", "explained")
