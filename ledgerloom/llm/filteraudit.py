"""Filter interaction audit by the Walsh-Hadamard transform.

Every document has a mask of the filters that it fails. What an order of the
filters keeps, removes and loses, and each filter's Shapley value, depend only
on how many documents have which mask. These cells are not counted as such: per
part and label class the job aggregates 2**k signed parity sums

    W[s] = sum over documents of (-1) ** popcount(mask & s)

which partial aggregation adds up task by task (2**k longs a part and class,
whatever the corpus), and the transform, being its own inverse up to 2**k, gives
the cells back exactly: cell[m] = sum over s of (-1) ** popcount(m & s) * W[s] / 2**k.

From the cells all k! orders are evaluated at once, and the Shapley value is a
closed form: of the orders, one in popcount(mask) has a given failing filter
first among those that fail, so a document adds k! / popcount(mask) to each
filter that it fails.

Whether a text repeats an earlier one is told without a window or a gathered
group: the smallest doc_id of each text (SHA-256) by a combining aggregation,
then an equi-join on text and doc_id, in which a text of very many copies meets
one row only.

Everything is built-in functions; no Python runs on a document.

Defined results: a null text is empty and a null part the empty string; a
document without labels is neither good nor toxic; of several labels of one
doc_id any 1 counts; a null label or other value is no 1. A row without doc_id
has no labels, repeats nothing and is repeated by nothing, as a comparison with
null says. Rows that share a doc_id and a text are each counted, and are no
repetition of each other. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def text_failures(text: Column) -> dict[str, Column]:
    """The five filters' failure conditions but the last (a repeated text), by letter; a condition is never null."""
    words = F.array_remove(F.split(text, SPACES, -1), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < 200, "B": distinct.cast("long") * 100 < n.cast("long") * 50, "C": capitals.cast("long") * 100 > F.char_length(text).cast("long") * 3, "D": text.rlike(r"[#$%&*|]")}


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, good, toxic, mask of every row; bit i of ``mask`` is the i-th letter of ABCDE."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    fails = text_failures(text)
    mask = sum((c.cast("int") * (1 << i) for i, c in enumerate(fails.values())), F.lit(0))
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("key"), mask.alias("mask"))
    named = measured.filter("doc_id is not null")
    first = named.groupBy("key").agg(F.min("doc_id").alias("first")).select(F.col("key").alias("_key"), "first")
    marked = named.join(first, (F.col("key") == F.col("_key")) & (F.col("doc_id") == F.col("first")), "left")
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_doc")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    told = marked.join(known, F.col("doc_id") == F.col("_doc"), "left")
    repeated = 1 << len(fails)
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = told.select("part", flag("good"), flag("toxic"), (F.col("mask") + F.when(F.col("first").isNull(), repeated).otherwise(0)).alias("mask"))
    return out.unionByName(measured.filter("doc_id is null").select("part", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "mask"))


def parity_sums(marked: DataFrame, filters: int) -> DataFrame:
    """part, good, toxic, ``w``: the 2**filters signed parity sums of the masks."""
    sign = lambda s: 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)
    sums = marked.groupBy("part", "good", "toxic").agg(*[F.sum(sign(s).cast("long")).alias(f"_w{s}") for s in range(1 << filters)])
    return sums.select("part", "good", "toxic", F.array(*[F.col(f"_w{s}") for s in range(1 << filters)]).alias("w"))


def cells(sums: DataFrame, filters: int) -> DataFrame:
    """part, and by mask the documents of all labels, of quality 1 and of toxic 1, from the sums added up by label; exact, as every sum over s is a multiple of 2**filters."""
    size = 1 << filters
    signed = F.transform("w", lambda x, s: x * (1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(s)) % 2)))
    masks_of = sums.select("part", "good", "toxic", "w", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("mask"))
    by_mask = masks_of.select("part", "good", "toxic", "mask", F.aggregate(signed, F.lit(0).cast("long"), lambda acc, x: acc + x).alias("n")).withColumn("n", F.expr(f"n div {size}"))
    counts = by_mask.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("good") == 1, F.col("n")).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("toxic"))
    return counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("mask", "n", "good", "toxic"))).alias("cells"))  # 2**filters entries


def evaluate(by_part: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step and the counts, for every order of the filters."""
    k = len(letters)
    bit = {x: 1 << i for i, x in enumerate(letters)}
    plans = [("".join(p), i + 1, sum(bit[x] for x in p[:i]), bit[p[i]]) for p in permutations(letters) for i in range(k)]
    orders = F.from_json(F.lit(_json(plans)), "array<struct<filter_order: string, step: int, before: int, own: int>>")
    rows = by_part.select("part", "cells", F.explode(orders).alias("o")).select("part", "cells", "o.*")
    mask = lambda c, bits: c["mask"].bitwiseAND(F.col(bits))
    total = lambda count, when: F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(when(c), count(c)).otherwise(0))
    n = lambda c: c["n"]
    here = lambda c: (mask(c, "own") != 0) & (mask(c, "before") == 0)
    return rows.select(
        "part", "filter_order", "step",
        total(n, lambda c: (mask(c, "own") == 0) & (mask(c, "before") == 0)).alias("kept"),
        total(n, here).alias("removed"),
        total(n, lambda c: (mask(c, "own") != 0) & (mask(c, "before") != 0)).alias("redundant"),
        total(n, lambda c: c["mask"] == F.col("own")).alias("unique_fails"),
        total(lambda c: c["good"], here).alias("good_lost"),
        total(lambda c: c["toxic"], here).alias("toxic_lost"),
        total(lambda c: c["n"] * _shares(c["mask"], k), lambda c: mask(c, "own") != 0).alias("shapley"),
    )


def _shares(mask: Column, k: int) -> Column:
    """k! / popcount(mask), a whole number, as popcount(mask) is one of 1 to k."""
    return F.get(F.array(F.lit(0).cast("long"), *[F.lit(factorial(k) // c).cast("long") for c in range(1, k + 1)]), F.bit_count(mask))


def _json(plans: list[tuple[str, int, int, int]]) -> str:
    import json

    return json.dumps([dict(zip(("filter_order", "step", "before", "own"), p, strict=True)) for p in plans])


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: one row per part, order and step."""
    letters = "ABCDE"
    return evaluate(cells(parity_sums(masks(docs, labels, part), len(letters)), len(letters)), letters)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
l AS (SELECT doc_id, max(coalesce(quality = 1, false)) AS good, max(coalesce(toxic = 1, false)) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS (SELECT w.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic,
             len(words) < 200 AS a, 100 * list_unique(words) < 50 * len(words) AS b,
             100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c,
             regexp_matches(text, '[#$%&*|]') AS d, coalesce(w.doc_id > first, false) AS e
      FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT part, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda x, i: [a, b, c, d, e][i]) AS fails, count(*) AS n FROM f GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM x p JOIN x q ON q.x <> p.x JOIN x r ON r.x NOT IN (p.x, q.x) JOIN x s ON s.x NOT IN (p.x, q.x, r.x) JOIN x t ON t.x NOT IN (p.x, q.x, r.x, s.x)),
k AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
g AS (SELECT m.*, filter_order, step, filter_order[step] AS own, list_min(list_transform(fails, lambda y: strpos(filter_order, y))) AS hit FROM m, k),
h AS (SELECT part, filter_order, step, any_value(own) AS own,
             sum(n) FILTER (WHERE hit IS NULL OR hit > step) AS kept, sum(n) FILTER (WHERE hit = step) AS removed,
             sum(n) FILTER (WHERE list_contains(fails, own) AND hit < step) AS redundant, sum(n) FILTER (WHERE fails = [own]) AS unique_fails,
             sum(n) FILTER (WHERE hit = step AND good) AS good_lost, sum(n) FILTER (WHERE hit = step AND toxic) AS toxic_lost
      FROM g GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
       CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost,
       CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM h
"""
