"""The ledger of payments that the shared Parquet tables stand for.

Orders give the client and its firm, suppliers the vendors, line items the
payments. Column pruning and filters reach the four scans; customer and nation
are dimension sides that adaptive execution broadcasts if they are small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _half_up(c):
    return F.floor(c + 0.5).cast("long")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per payment; ``deleted`` marks tombstones."""
    li, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    s, k, p = F.col("l_suppkey"), F.col("l_linenumber"), F.col("l_partkey")
    name = F.when(s % 10 < 2, F.concat(F.lit("SHARED "), F.floor(s / 10).cast("string"))).when(s % 10 == 9, F.concat(F.lit("NOTIN "), s.cast("string"))).otherwise(F.concat(F.lit("VENDOR "), s.cast("string")))
    cents = _half_up(F.col("l_extendedprice") * 100)
    amount = F.when((F.col("l_discount") == 0.1) & (F.col("l_tax") == 0), F.lit(0)).otherwise(cents * F.when((F.col("l_returnflag") == "R") & (k >= 6), -1).otherwise(1))
    method = F.when((p % 20).isin(3, 11, 19), "CREDIT_CARD").when((p % 20).isin(7, 15), "TPSO").when(p % 2 == 0, "CHECK").otherwise("ACH")
    joined = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    base = joined.select(
        F.col("n_regionkey").alias("firm_id"), F.col("c_nationkey").alias("client_id"),
        F.concat_ws("-", "l_orderkey", k, p, s, cents).alias("line_id"),
        F.when(p % 3 == 0, "QUICKBOOKS").when(p % 3 == 1, "XERO").otherwise("SPREADSHEET").alias("source_system"),
        name.alias("name_norm"),
        F.when((s % 10 == 9) | (k == 3), None).otherwise(F.substring(F.sha2(F.concat(F.lit("tin"), s.cast("string")), 256), 1, 16)).alias("tin_bidx"),
        F.when((s % 10 == 9) & (k == 2), "MALFORMED").when((s % 10 == 9) | (k == 3), "MISSING").otherwise("PRESENT").alias("tin_status"),
        F.col("l_shipdate").cast("date").alias("payment_date"), F.year("l_shipdate").alias("tax_year"),
        amount.alias("amount_cents"),
        F.when((s % 33 == 5) & (F.col("l_tax") >= 0.07), _half_up(F.col("l_extendedprice") * 24)).otherwise(0).alias("withholding_cents"),
        method.alias("method"), s.alias("suppkey"), k.alias("linenumber"),
        F.when(p % 6 == 0, "MERCHANDISE").otherwise("SERVICES").alias("expense_class"),
        F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") >= 49), "VOID").when(amount < 0, "REVERSAL").otherwise("PAYMENT").alias("entry_type"),
        ((F.col("l_quantity") == 1) & (k == 1)).alias("deleted"),
    )
    return base.withColumns({
        "name_raw": F.when(F.col("linenumber") % 3 == 0, F.concat("name_norm", F.lit(", LLC"))).when(F.col("linenumber") % 3 == 1, F.col("name_norm")).otherwise(F.lower("name_norm")),
        "tin_last4": F.when(F.col("tin_status") == "PRESENT", F.lpad((F.col("suppkey") % 10000).cast("string"), 4, "0")),
        "is_card": F.col("method").isin("CREDIT_CARD", "TPSO"),
    })


def aliases(lines: DataFrame) -> DataFrame:
    """Human-made aliases: (firm_id, client_id, alias_key, canonical_key)."""
    return lines.filter("suppkey % 30 = 9").select("firm_id", "client_id", F.concat(F.lit("NAME:"), "name_norm").alias("alias_key"), F.concat(F.lit("ALIAS:"), F.floor(F.col("suppkey") / 100).cast("string")).alias("canonical_key")).distinct()


LEDGER_SQL = """
ledger AS (
 SELECT *, CASE WHEN linenumber % 3 = 0 THEN name_norm || ', LLC' WHEN linenumber % 3 = 1 THEN name_norm ELSE lower(name_norm) END AS name_raw,
        CASE WHEN tin_status = 'PRESENT' THEN lpad(CAST(suppkey % 10000 AS VARCHAR), 4, '0') END AS tin_last4,
        method IN ('CREDIT_CARD', 'TPSO') AS is_card
 FROM (
  SELECT n_regionkey AS firm_id, c_nationkey AS client_id,
   l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) AS line_id,
   CASE l_partkey % 3 WHEN 0 THEN 'QUICKBOOKS' WHEN 1 THEN 'XERO' ELSE 'SPREADSHEET' END AS source_system,
   CASE WHEN l_suppkey % 10 < 2 THEN 'SHARED ' || (l_suppkey // 10) WHEN l_suppkey % 10 = 9 THEN 'NOTIN ' || l_suppkey ELSE 'VENDOR ' || l_suppkey END AS name_norm,
   CASE WHEN l_suppkey % 10 = 9 OR l_linenumber = 3 THEN NULL ELSE substr(sha256('tin' || l_suppkey), 1, 16) END AS tin_bidx,
   CASE WHEN l_suppkey % 10 = 9 AND l_linenumber = 2 THEN 'MALFORMED' WHEN l_suppkey % 10 = 9 OR l_linenumber = 3 THEN 'MISSING' ELSE 'PRESENT' END AS tin_status,
   CAST(l_shipdate AS DATE) AS payment_date, CAST(year(l_shipdate) AS INTEGER) AS tax_year,
   CASE WHEN l_discount = 0.1::DOUBLE AND l_tax = 0 THEN 0 ELSE CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * CASE WHEN l_returnflag = 'R' AND l_linenumber >= 6 THEN -1 ELSE 1 END END AS amount_cents,
   CASE WHEN l_suppkey % 33 = 5 AND l_tax >= 0.07::DOUBLE THEN CAST(floor(l_extendedprice * 24 + 0.5) AS BIGINT) ELSE 0 END AS withholding_cents,
   CASE WHEN l_partkey % 20 IN (3, 11, 19) THEN 'CREDIT_CARD' WHEN l_partkey % 20 IN (7, 15) THEN 'TPSO' WHEN l_partkey % 2 = 0 THEN 'CHECK' ELSE 'ACH' END AS method,
   l_suppkey AS suppkey, l_linenumber AS linenumber,
   CASE WHEN l_partkey % 6 = 0 THEN 'MERCHANDISE' ELSE 'SERVICES' END AS expense_class,
   CASE WHEN l_linestatus = 'O' AND l_quantity >= 49 THEN 'VOID'
        WHEN l_returnflag = 'R' AND l_linenumber >= 6 AND NOT (l_discount = 0.1::DOUBLE AND l_tax = 0) THEN 'REVERSAL' ELSE 'PAYMENT' END AS entry_type,
   l_quantity = 1 AND l_linenumber = 1 AS deleted
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) x),
live AS (SELECT * FROM ledger WHERE NOT deleted),
alias AS (SELECT DISTINCT firm_id, client_id, 'NAME:' || name_norm AS alias_key, 'ALIAS:' || (suppkey // 100) AS canonical_key FROM live WHERE suppkey % 30 = 9)"""
