"""MinHash near-dedup with sequential Bayesian verification.

1. Every text becomes its set of distinct word shingles (64-bit hashes). Texts
   with equal sets are one class, known by a 128-bit digest of the set; from
   here on each class has one representative, so copies never meet each other.
2. Representatives get ``bands * rows`` MinHash values; equal bands make
   candidates. In each bucket candidates are compared with one hub (a star, one
   pair a member); once components are known, members that are still in
   different components are compared, in crowded buckets within a task and
   without a row a pair. So no link between different texts is lost that a
   component needs, and a bucket whose members belong together costs a pair a
   member.
3. A candidate pair's signatures are compared in batches of 16. With a uniform
   prior the similarity's posterior after m matches of n is Beta(m+1, n-m+1);
   as soon as P(similarity >= threshold) is small enough the pair is pruned. How
   small is set so that over all batches together a pair of exactly the
   threshold is pruned with a probability of at most ``miss``. The least m that
   survives is tabled for each batch.
4. Survivors are verified on the full shingle sets:
   100 * intersection >= 100 * threshold * union.
5. Links give components (``links.components``) on the cluster.

Defined results: a null or empty text, or one without words, has an empty set,
is linked with nothing and is its own component; fewer words than a shingle
give one shingle, the whole sequence; repeated rows with one doc_id are one
node, linked by whichever of their texts; an empty table gives an empty result; rows without a doc_id are left out
of the links and come back as components of their own (null).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, docs_of, keep, release, without
from .links import components
from .wordhash import U, mix, shingles, unique_by_row, word_blocks

BATCH = 16
STAGED = "doc_id long, n_shingles long, k1 long, k2 long, signature binary"


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return x[:n] | U(1), x[n:]


def signatures(values: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """(rows, n) MinHash values (upper 32 bits) of non-empty rows of distinct shingle hashes."""
    a, b = _hash_family(n)
    out = np.empty((len(offsets) - 1, n), np.uint32)
    work = np.empty(len(values), U)
    for j in range(n):
        np.multiply(values, a[j], out=work)
        np.add(work, b[j], out=work)
        out[:, j] = np.minimum.reduceat(work, offsets[:-1]) >> U(32)
    return out


def _stage(words: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, hashes, by_row, _, _ in word_blocks(b.column("text"), lower=True):
                values, offsets = unique_by_row(*shingles(hashes, by_row, words))
                sizes = np.diff(offsets)
                some = np.flatnonzero(sizes)
                k1, k2 = np.zeros(len(sizes), U), np.zeros(len(sizes), U)
                sig: list = [None] * len(sizes)
                if len(some):
                    at = offsets[:-1][some]
                    k1[some] = np.add.reduceat(mix(values ^ U(0x1234567)), at)
                    k2[some] = np.add.reduceat(mix(values * U(0xD1342543DE82EF95)), at)
                    raw = signatures(values, np.append(at, len(values)), n).astype("<u4")
                    for i, r in zip(some, raw, strict=True):
                        sig[i] = r.tobytes()
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, last - first), pa.array(sizes), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "k1", "k2", "signature"])

    return run


def _bands(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(b.column("signature").to_pylist()), "<u4").reshape(n, -1).astype(U)
            keys = np.empty((n, bands), U)
            for j in range(bands):
                h = np.full(n, j + 1, U)
                for r in range(rows):
                    h = h * U(0x9E3779B97F4A7C15) + sig[:, j * rows + r]
                keys[:, j] = mix(h ^ (h >> U(31)))
            take = pa.array(np.repeat(np.arange(n), bands))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), b.column("rep").take(take), b.column("n").take(take)], names=["bucket", "rep", "n"])

    return run


def _beta_tail(m: int, n: int, t: float) -> float:
    """P(s >= t) for s ~ Beta(m + 1, n - m + 1): a binomial sum."""
    return sum(math.comb(n + 1, i) * t**i * (1 - t) ** (n + 1 - i) for i in range(m + 1))


def least_matches(n: int, threshold: float, miss: float) -> list[int]:
    """For 16, 32, ... n compared values: the fewest matches of a pair that is not pruned."""
    out = []
    for k in range(BATCH, n + 1, BATCH):
        out.append(next(m for m in range(k + 1) if m == k or _beta_tail(m, k, threshold) > miss))
    return out


def loss(least: list[int], similarity: float) -> float:
    """The probability that a pair of this similarity is pruned in any of the batches."""
    one = np.array([math.comb(BATCH, i) * similarity**i * (1 - similarity) ** (BATCH - i) for i in range(BATCH + 1)])
    live = np.ones(1)
    for need in least:
        live = np.convolve(live, one)
        live[:need] = 0.0
    return 1.0 - float(live.sum())


def pruning_table(n: int, threshold: float, miss: float) -> list[int]:
    """``least_matches`` at a posterior low enough that all batches together prune a pair of exactly the threshold with a probability of at most ``miss``."""
    posterior = miss
    while loss(least := least_matches(n, threshold, posterior), threshold) > miss:
        posterior /= 2
    return least


def _prune(least: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u4").reshape(n, -1) for c in ("sa", "sb"))
            live, same = np.arange(n), np.zeros(n, np.int64)
            for k, need in enumerate(least):
                part = slice(k * BATCH, (k + 1) * BATCH)
                same[live] += (x[live, part] == y[live, part]).sum(1)
                live = live[same[live] >= need]
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(live)) for c in ("a", "b")], names=["a", "b"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, hashes, by_row, _, _ in word_blocks(b.column("text"), lower=True):
                values, offsets = unique_by_row(*shingles(hashes, by_row, words))
                at = np.minimum(offsets[:-1], max(len(values) - 1, 0))
                digest = np.add.reduceat(mix(values ^ U(0x1234567)), at) if len(values) else np.zeros(len(at), U)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, last - first), pa.array(digest.view(np.int64)), pa.array([values[i:j].tobytes() for i, j in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())], names=["rep", "digest", "shingles"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for i, (x, y) in enumerate(zip(b.column("xa"), b.column("xb"), strict=True)):
                p, q = (np.frombuffer(v.as_buffer(), U) for v in (x, y))
                both = np.concatenate([p, q])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(good, pa.int64())) for c in ("a", "b")], names=["a", "b"])

    return run


def link_crowd(shape: tuple[np.ndarray, ...], signature: np.ndarray, values: np.ndarray, offsets: np.ndarray, least: list[int], percent: int, same_block: bool) -> list[tuple[int, int]]:
    """Links between the components of one crowded bucket: each member outside the largest component is compared with all members of other components (Bayesian pruning on signatures, then the exact test), and one link to each component found is enough.

    ``shape``: ids, set sizes, labels and blocks; unless ``same_block`` only members of different blocks meet.
    """
    ids, n, label, block = shape
    kinds, label, count = np.unique(label, return_inverse=True, return_counts=True)
    order = np.flatnonzero(label != count.argmax())
    dense = np.unique(values, return_inverse=True)[1]
    flag = np.zeros(dense.max() + 1 if len(dense) else 1, bool)
    out = []
    for x in order.tolist():
        fits = (label != label[x]) & (100 * np.minimum(n, n[x]) >= percent * np.maximum(n, n[x]))
        if not same_block:
            fits &= block != block[x]
        live = np.flatnonzero(fits)
        same = np.zeros(len(live), np.int64)
        for k, need in enumerate(least):
            part = slice(k * BATCH, (k + 1) * BATCH)
            same += (signature[live, part] == signature[x, part]).sum(1)
            on = same >= need
            live, same = live[on], same[on]
            if not len(live):
                break
        if not len(live):
            continue
        own = dense[offsets[x] : offsets[x + 1]]
        flag[own] = True
        shared = np.array([np.count_nonzero(flag[dense[offsets[y] : offsets[y + 1]]]) for y in live.tolist()])
        flag[own] = False
        for y in live[100 * shared >= percent * (n[x] + n[live] - shared)].tolist():
            if label[y] != label[x]:
                out.append((int(ids[x]), int(ids[y])))
                label[label == label[x]] = label[y]
    return out


def _crowds(least: list[int], percent: int):
    def solve(rows: list[dict]) -> list[tuple[int, int]]:
        col = lambda c: np.array([r[c] for r in rows])
        sets = [np.frombuffer(r["shingles"], U) for r in rows]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
        signature = np.frombuffer(b"".join(r["signature"] for r in rows), "<u4").reshape(len(rows), -1)
        return link_crowd((col("rep"), col("n"), col("label"), col("block")), signature, np.concatenate(sets), offsets, least, percent, rows[0]["lo"] == rows[0]["hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            found = []
            for at in range(0, b.num_rows, 256):
                for r in b.slice(at, 256).to_pylist():
                    now = r["bucket"], r["lo"], r["hi"]
                    if now != key and rows:
                        found += solve(rows)
                        rows = []
                    key = now
                    rows.append(r)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
        if rows and (found := solve(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

    return run


class NearDuplicates:
    """One run: classes with their representatives, buckets, and the links found so far."""

    def __init__(self, docs: DataFrame, words: int, threshold: float, bands: int, rows: int, miss: float, crowd_at: int, crowd_shingles: int, broadcast_ids: int):
        self.docs, self.spark = docs_of(docs), docs.sparkSession
        self.words, self.percent, self.bands, self.rows = words, round(100 * threshold), bands, rows
        self.least = pruning_table(bands * rows // BATCH * BATCH, threshold, miss)
        self.crowd_at, self.crowd_shingles, self.broadcast_ids = crowd_at, crowd_shingles, broadcast_ids

    def classes(self) -> None:
        """All rows with their set's digest, and one row (smallest doc_id, signature) a class of equal sets; copies meet in partial minima."""
        self.staged = keep(arrow_map(self.docs, _stage(self.words, self.bands * self.rows), STAGED), "signatures")
        best = self.staged.filter("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2", "n_shingles").agg(F.min(F.struct("doc_id", "signature")).alias("m"))
        self.reps = keep(best.select("k1", "k2", F.col("n_shingles").alias("n"), F.col("m.doc_id").alias("rep"), F.col("m.signature").alias("signature")), "reps")
        release(self.spark)

    def buckets(self) -> None:
        """Every representative in every bucket that another one shares, with the bucket's hub (its smallest doc_id)."""
        banded = arrow_map(self.reps.select("rep", "n", "signature"), _bands(self.bands, self.rows), "bucket long, rep long, n long")
        full = banded.groupBy("bucket").agg(F.min("rep").alias("hub"), F.max("rep").alias("most")).filter("hub < most")
        self.crowd = keep(banded.join(full.select("bucket", "hub"), "bucket"), "buckets")

    def open_buckets(self, labels: DataFrame) -> DataFrame:
        """Bucket rows with labels, of those buckets whose members are not all in one component, and how many members and shingles they have."""
        rows = self.crowd.join(labels, F.col("rep") == F.col("node"), "left").select("bucket", "rep", "n", F.coalesce("component", "rep").alias("label"))
        open_ = rows.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members"), F.sum("n").alias("all")).filter("lo < hi").drop("lo", "hi")
        return keep(rows.join(open_, "bucket"), "open")

    def rest(self, rows: DataFrame) -> DataFrame:
        """All pairs of an open bucket's members in different components; members are dealt by size class, so only sizes that the threshold allows meet."""
        base = math.log(100 / self.percent)
        step = F.floor(F.log("n") / base)
        x = rows.select("bucket", step.alias("step"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("label").alias("la"))
        y = rows.select("bucket", F.explode(F.array(step - 1, step, step + 1)).alias("step"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("label").alias("lb"))
        fits = 100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb")
        return x.join(y, ["bucket", "step"]).filter("a < b and la <> lb").filter(fits).select("a", "b").distinct()

    def sets_of(self, ids: DataFrame) -> DataFrame:
        """(rep, shingles) of the given doc_ids, from their texts; rows that share a doc_id give each of their different sets."""
        ids = keep(ids.distinct(), "ids")
        wanted = F.broadcast(ids) if ids.count() <= self.broadcast_ids else ids  # 8 bytes an id
        out = keep(arrow_map(self.docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text"), _sets(self.words), "rep long, digest long, shingles binary").dropDuplicates(["rep", "digest"]).drop("digest"), "sets")
        discard(ids)
        return out

    def crowds(self, rows: DataFrame) -> DataFrame:
        """Links between components within crowded buckets, found inside a task. A bucket with more than ``crowd_shingles`` shingles is dealt to blocks, and each pair of blocks is one group, so memory is bounded; no pair is emitted but links."""
        sets = self.sets_of(rows.select(F.col("rep").alias("doc_id")))
        blocks = F.greatest(F.ceil(F.col("all") / self.crowd_shingles), F.lit(1)).cast("int")
        dealt = rows.withColumn("block", F.pmod(F.xxhash64("rep"), blocks.cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        dealt = dealt.select("bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "rep", "n", "label", "block")
        full = dealt.join(self.reps.select("rep", "n", "signature"), ["rep", "n"]).join(sets, "rep")
        found = keep(arrow_map(full.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi"), _crowds(self.least, self.percent), "a long, b long").distinct(), "crowds")
        discard(sets)
        return found

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Links among candidate pairs: Bayesian pruning on signatures, then the exact test on full sets."""
        a = pairs.join(self.reps.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa")), "a")
        both = a.join(self.reps.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb")), "b")
        both = both.filter(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
        likely = keep(arrow_map(both.select("a", "b", "sa", "sb"), _prune(self.least), "a long, b long"), "likely")
        sets = self.sets_of(likely.select(F.explode(F.array("a", "b")).alias("doc_id")))
        pa_ = likely.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("xa")), "a")
        full = pa_.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("xb")), "b")
        found = keep(arrow_map(full.select("a", "b", "xa", "xb"), _verify(self.percent), "a long, b long"), "found")
        discard(likely, sets)
        release(self.spark)
        return found

    def run(self) -> DataFrame:
        self.classes()
        self.buckets()
        links = self.verify(self.crowd.filter("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct())
        labels = components(links)
        rows = self.open_buckets(labels)
        crowded = F.col("members") >= self.crowd_at
        small, large = rows.agg(F.count(F.when(~crowded, 1)), F.count(F.when(crowded, 1))).first()
        more = [self.verify(self.rest(rows.filter(~crowded)))] if small else []
        more += [self.crowds(rows.filter(crowded))] if large else []
        discard(rows, self.crowd)
        if more:
            settled = labels
            labels = components(reduce(DataFrame.unionByName, more), settled)
            discard(settled, *more)
        discard(links)
        firsts = self.reps.select("k1", "k2", F.col("n").alias("n_shingles"), "rep").join(labels, F.col("rep") == F.col("node"), "left")
        firsts = firsts.select("k1", "k2", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
        own = self.staged.select("doc_id", "n_shingles", "k1", "k2").join(firsts, ["k1", "k2", "n_shingles"], "left")
        component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        return own.select("doc_id", "n_shingles", component.alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 6, miss: float = 0.001, crowd_at: int = 64, crowd_shingles: int = 2_000_000, broadcast_ids: int = 1_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links of at least ``threshold``), kept.

    ``miss`` bounds the probability that pruning loses a pair of exactly
    ``threshold``, all batches together; after the hubs' round the members still
    apart are compared: as pairs in buckets of fewer than ``crowd_at`` members,
    inside tasks in others.
    """
    found = NearDuplicates(docs, words, threshold, bands, rows, miss, crowd_at, crowd_shingles, broadcast_ids).run()
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, broadcast_ids: int = 1_000_000, **options) -> DataFrame:
    """The documents (all their columns) that stand for their group; rows that share a doc_id are one document and stay or go together."""
    return without(docs, near_duplicates(docs, **options).filter("not kept").select("doc_id"), "copies", broadcast_ids)
