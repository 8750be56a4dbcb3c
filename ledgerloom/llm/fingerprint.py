"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the sorted array of the k smallest distinct 48-bit shingle hashes.
Two sketches merge by union, sort and cut, so sketches of parts give the sketch
of the whole. From sketches alone come estimates of resemblance, containment
and the number of distinct shingles. A shingle is five consecutive words
(``[^\\x20\\x09-\\x0D]+``); a text of one to four words is one shingle.

Defined results: a null or empty text has an empty sketch (fingerprint ''); two
empty sketches have likeness 1, an empty and another one 0; equal texts have
equal fingerprints; repeated rows keep their rows and follow each other in
order of text; a single document is its own next document; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import docs_of, keep

SPAN = 2.0**48
MASK = (1 << 48) - 1


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, k: int = 128, words: int = 5) -> Column:
    """The bottom-k sketch of a text as array<bigint>."""
    parts = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def of_hashes(h: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - words, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(words)]).bitwiseAND(F.lit(MASK)))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.slice(F.array_sort(F.array_distinct(runs)), 1, k))

    return _let(F.transform(parts, lambda w: F.xxhash64(w)), of_hashes)


def merge(a: Column, b: Column, k: int = 128) -> Column:
    """The sketch of the union of two shingle sets."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated shared shingles over all shingles of both."""
    def of(union: Column) -> Column:
        return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union))

    return _let(merge(a, b, k), of)


def distinct_count(a: Column, k: int = 128) -> Column:
    """Estimated distinct shingles: exact below k, else (k - 1) over the k-th smallest hash as a fraction."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * SPAN / (F.element_at(a, k) + 1))


def containment(a: Column, b: Column, k: int = 128) -> Column:
    """Estimated share of a's shingles that b has too: resemblance times the size of the union over a's size, 1 at most."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k)))


def as_text(a: Column) -> Column:
    """12 hexadecimal digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), 12, "0")), "")


def with_next(docs: DataFrame, rows_a_group: int = 500, broadcast_groups: int = 1_000_000) -> DataFrame:
    """``docs`` (doc_id, text, further columns) with ``next``, a struct of text and further columns of the row that follows by ascending doc_id; the first row follows the last.

    Rows are grouped by ranges of ids: approximate quantiles, each cut into equal parts, so no task holds more than a few thousand rows of spread ids. The first row of each group is also sent, as a guest, to the group before it.
    """
    spark = docs.sparkSession
    ids = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [i / 64 for i in range(65)], 10_000)).first()
    n, low, high, marks = ids[0], ids[1], ids[2], sorted(set(ids[3] or [0]))
    marks = [low or 0, *[m for m in marks if (low or 0) < m <= (high or 0)]]
    lows, starts = F.array(*[F.lit(m).cast("long") for m in marks]), F.array(*[F.lit(float(m)) for m in marks])
    widths = F.array(*[F.lit(max(float(b) - float(a), 1.0)) for a, b in zip(marks, [*marks[1:], (high or 0) + 1], strict=True)])  # in doubles: no overflow, and rounding keeps the order
    parts = max(1, -(-n // (rows_a_group * len(marks))))
    level = F.greatest(F.size(F.filter(lows, lambda m: m <= F.col("doc_id"))), F.lit(1))
    at = (F.col("doc_id").cast("double") - F.element_at(starts, F.col("_level"))) / F.element_at(widths, F.col("_level"))
    group = F.when(F.col("doc_id").isNull(), -1).otherwise(F.col("_level") * F.lit(parts) + F.least(F.floor(at * parts), F.lit(parts - 1))).cast("long")
    placed = docs.withColumn("_level", F.coalesce(level, F.lit(1))).withColumn("_group", group).drop("_level")
    rest = [c for c in docs.columns if c != "doc_id"]

    heads = keep(placed.groupBy("_group").agg(F.min("doc_id").alias("_head")), "heads")
    # The group before each one: within a level by a window, and across levels by their last groups (one row a level).
    level_of = F.floor(F.col("_group") / parts).alias("_l")
    lasts = [(r["_l"], r["last"]) for r in heads.groupBy(level_of).agg(F.max("_group").alias("last")).orderBy("_l").collect()]
    before = spark.createDataFrame([(x, lasts[k - 1][1]) for k, (x, _) in enumerate(lasts)], "_m long, _before long")
    own = heads.select("_group", "_head", level_of).join(F.broadcast(before), F.col("_l") == F.col("_m"))
    guests = own.select(F.col("_group").alias("_g"), "_head", F.coalesce(F.lag("_group").over(Window.partitionBy("_l").orderBy("_group")), "_before").alias("_guest_of"))
    if n <= rows_a_group * broadcast_groups:  # n / rows_a_group rows of 24 bytes, give or take the empty groups
        guests = F.broadcast(guests)
    both = placed.join(guests, (F.col("_group") == F.col("_g")) & F.col("doc_id").eqNullSafe(F.col("_head")), "left")
    dealt = both.withColumn("_to", F.explode(F.when(F.col("_guest_of").isNull(), F.array(F.struct(F.col("_group").alias("g"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("_group").alias("g"), F.lit(False).alias("guest")), F.struct(F.col("_guest_of").alias("g"), F.lit(True).alias("guest"))))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-n // (8 * rows_a_group)), 100_000))
    dealt = dealt.repartition(tasks, "_to.g")  # a few groups a task, however many rows there are
    order = Window.partitionBy("_to.g").orderBy(F.col("_to.guest"), F.col("doc_id").asc_nulls_first(), F.col("text"))
    return dealt.withColumn("next", F.lead(F.struct(*rest)).over(order)).filter(~F.col("_to.guest")).select("doc_id", *rest, "next")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last floor(n/4) code points replaced by as many first ones (or all) of ``following``."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprints(docs: DataFrame, k: int = 128, words: int = 5) -> DataFrame:
    """doc_id, n_chars, edited text, sketches of the text, of its edited form and of the next document."""
    both = with_next(docs_of(docs).withColumn("sketch", sketch(F.col("text"), k, words)))
    out = both.select("doc_id", F.char_length("text").alias("n_chars"), edited(F.col("text"), F.col("next.text")).alias("edited"), "sketch", F.col("next.sketch").alias("next_sketch"))
    return out.withColumn("edited_sketch", sketch(F.col("edited"), k, words))
