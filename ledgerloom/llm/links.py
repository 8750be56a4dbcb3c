"""Connected components of a table of links, on the cluster.

Alternating large-star and small-star rounds: each is an aggregation (with
partial minima, so a node with very many links is one row per map task) and a
join. Every round is written to the shared folder, and its count and checksum
are observed while it is written: nothing else reaches the driver, and no
round is read again only to see whether it changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import discard, keep


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked with its smallest neighbour (itself included)."""
    both = _both(links)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked with the smallest of these."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    other = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return other.filter("a <> b").distinct()


def components(links: DataFrame, settled: DataFrame | None = None, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the smallest node reachable. ``settled`` holds (node, component) of links known before."""
    if settled is not None:
        links = links.select("a", "b").unionByName(settled.select(F.col("node").alias("a"), F.col("component").alias("b")))
    now, made, mark = links, None, None
    for _ in range(rounds):
        seen = Observation()
        new = _small_star(_large_star(now)).observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))), F.lit(0)).alias("sum"))
        new = keep(new, "links")
        if made is not None:
            discard(made)
        now = made = new
        if seen.get == mark:
            break
        mark = seen.get
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    found = keep(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "labels")
    discard(made)
    return found
