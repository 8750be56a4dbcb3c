"""Substring dedup of word sequences by prefix-partitioned suffix trees.

1. **Suffixes.** Of every ``reach`` neighbouring positions the one whose rolling
   hash over ``gram`` words is smallest starts a suffix, so every window of
   ``width`` words has one that starts in it, chosen by the window's own words: it
   is the window's first ``d`` words and then the first ``width - d`` of the suffix.
2. **Prefixes.** Suffixes are split by a prefix of ``width - reach + 1`` words, which
   all windows on the suffix contain. A prefix that occurs once is a leaf and is
   dropped after one count; this is most of a corpus. Suffixes with equal
   surroundings in all their windows are one, known by a hash, of which only the
   smallest doc_id matters. Where the counts show more than ``group_most``
   different suffixes under a prefix, it is too short: the windows are split by
   ``d`` into ranges of ``steps`` width, the suffix starts where the range does, and
   its prefix grows to all but that width of a window. Prefixes so have 27, 45 or
   50 words by default, as the counts ask for; one of all 50 is a node by itself,
   and its smallest doc_id an aggregate.
3. **Subtrees.** The suffixes under one prefix, sorted, with the lengths of their
   common prefixes, are a subtree: its inner nodes at depth ``r`` are the intervals
   whose common prefixes reach ``r``. A node extended to the left by the words
   before its suffixes, as far as they agree, is a maximal repeat; where both
   together reach ``width`` words its windows repeat, and the smallest doc_id below
   keeps them.

Removed is each word covered by a window of ``width`` words that also starts in
a document with a smaller doc_id.

Defined results: a null or empty text has no words; a document never loses words
to itself or to rows with its own doc_id; a null doc_id counts as smaller than
all others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, keep, release
from .spans import CHUNK, by_group, gathered, join_all, modest, more_of, neighbours, pack, remove, start_of, stretches, unpack
from .wordhash import BASE_INV, U, mix, powers, prefix_sums, word_blocks

_POS = U((1 << 20) - 1)
OWNER = ("id", "h1", "h2")


@dataclass(frozen=True)
class Tree:
    width: int
    reach: int
    gram: int


def suffixes(values: np.ndarray, offsets: np.ndarray, t: Tree) -> tuple[np.ndarray, ...]:
    """(row, first window, further windows, words before the suffix, prefix, surroundings) of every chosen suffix; windows count from the row's start."""
    n, width, reach, gram = len(values), t.width, t.reach, t.gram
    fits = np.flatnonzero(np.diff(offsets) >= width)
    if not len(fits):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),) * 2
    sums, back = prefix_sums(values), powers(n + 1, BASE_INV)
    least = (mix((sums[gram:] - sums[:-gram]) * back[: n - gram + 1]) & ~_POS) | (_POS - np.arange(n - gram + 1, dtype=U))
    span = 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    marks = np.zeros(n + 1, np.int32)
    marks[offsets[fits]] += 1
    marks[offsets[fits + 1] - width + 1] -= 1
    window = np.flatnonzero(np.cumsum(marks) > 0)
    chosen = (_POS - (least[window] & _POS)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (window[1:] != window[:-1] + 1)
    s, at = window[new], chosen[new]
    e = window[np.append(np.flatnonzero(new)[1:], len(window)) - 1]
    prefix = mix((sums[at + width - reach + 1] - sums[at]) * back[at])
    around = mix(mix((sums[e + width] - sums[s]) * back[s]) + U(0xD1342543DE82EF95) * (at - s).astype(U) + U(0xC2B2AE3D27D4EB4F) * (e - s).astype(U))
    row = np.searchsorted(offsets, s, side="right") - 1
    return row, s - offsets[row], e - s, at - s, prefix, around


def _suffixes_of_rows(values: np.ndarray, offsets: np.ndarray, t: Tree) -> Iterator[tuple[np.ndarray, ...]]:
    """``suffixes`` for blocks of any length: a long row is read in chunks that overlap by a window."""
    if len(values) <= CHUNK * 2 - t.width:
        yield suffixes(values, offsets, t)
        return
    for r in range(len(offsets) - 1):
        own = values[offsets[r] : offsets[r + 1]]
        for at in range(0, max(1, len(own) - t.width + 1), CHUNK):
            part = own[at : at + CHUNK + t.width - 1]
            _, s, *rest = suffixes(part, np.array([0, len(part)]), t)
            yield np.full(len(s), r), s + at, *rest


def _prefixes(t: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [b.column(c).to_numpy() for c in OWNER]
            for first, _, values, offsets, _, _ in word_blocks(b.column("text")):
                for row, s, more, dist, prefix, around in _suffixes_of_rows(values, offsets, t):
                    yield pa.RecordBatch.from_arrays([pa.array(prefix.view(np.int64)), pa.array(around.view(np.int64)), *[pa.array(c[row + first]) for c in own], pa.array(pack(s, more, dist))], names=["prefix", "around", *OWNER, "p"])

    return run


GROWN = "prefix long, id long, h1 long, h2 long, p long, skip long, more long, dist long, content binary"


def _fetch(t: Tree):
    """The words (as hashes) of each listed suffix and of what stands before it in its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column("items")
            bounds, flat = np.asarray(items.offsets), items.values
            prefix, p, under = (np.asarray(flat.field(c)) for c in ("prefix", "p", "under"))
            s, more, dist = unpack(p)
            for first, last, values, offsets, _, _ in word_blocks(b.column("text")):
                raw = memoryview(values.astype(">u8").tobytes())
                lo, hi = bounds[first], bounds[last]
                row = np.repeat(np.arange(first, last), np.diff(bounds[first : last + 1]))
                a = (offsets[row - first] + s[lo:hi]) * 8
                z = a + (more[lo:hi] + t.width) * 8
                for at in range(0, hi - lo, 2_000):
                    part = slice(at, min(at + 2_000, hi - lo))
                    own, of = slice(lo + part.start, lo + part.stop), pa.array(row[part])
                    content = pa.array([bytes(raw[i:j]) for i, j in zip(a[part].tolist(), z[part].tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(prefix[own]), *[b.column(c).take(of) for c in OWNER], pa.array(p[own]), pa.array(np.zeros(len(of), np.int64)), pa.array(more[own]), pa.array(dist[own]), content, pa.array(under[own])], names=["prefix", *OWNER, "p", "skip", "more", "dist", "content", "under"])

    return run


def _longer(t: Tree, step: int):
    """Each suffix once for every range of ``step`` distances that its windows have: it starts at the range's least distance before the old start, and its prefix takes all but the range's width of a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old, skip, more, dist = (b.column(c).to_numpy() for c in ("prefix", "skip", "more", "dist"))
            low, high = (dist - more) // step, dist // step
            for at in range(0, b.num_rows, 500):
                rows = np.arange(at, min(at + 500, b.num_rows))
                of = np.repeat(rows, high[rows] - low[rows] + 1)
                g = np.concatenate([np.arange(a, z + 1) for a, z in zip(low[rows].tolist(), high[rows].tolist(), strict=True)])
                longest = np.minimum(dist[of], (g + 1) * step - 1)  # distances of the first and the last window kept
                shortest = np.maximum(dist[of] - more[of], g * step)
                jump = dist[of] - longest
                contents = b.column("content")
                parts, keys = [], []
                for i, a, m, d, k in zip(of.tolist(), jump.tolist(), (longest - shortest).tolist(), (longest - g * step).tolist(), g.tolist(), strict=True):
                    part = contents[i].as_buffer().to_pybytes()[8 * a : 8 * (a + m + t.width)]
                    parts.append(part)
                    keys.append(hashlib.blake2b(part[8 * d : 8 * (d + t.width - step + 1)] + bytes([k]) + old[i].tobytes(), digest_size=8).digest())
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(keys), np.int64)), *[b.column(c).take(pa.array(of)) for c in (*OWNER, "p")], pa.array(skip[of] + jump), pa.array(longest - shortest), pa.array(longest - g * step), pa.array(parts, pa.binary())], names=[f.split(" ")[0] for f in GROWN.split(", ")])

    return run


def subtrees(prefix: np.ndarray, ids: np.ndarray, more: np.ndarray, dist: np.ndarray, contents: list[bytes], width: int) -> np.ndarray:
    """Windows that a smaller id has too, a boolean by suffix and window, of whole groups of equal prefixes (sorted by prefix)."""
    size = len(prefix)
    group = np.concatenate([[0], np.cumsum(prefix[1:] != prefix[:-1])])
    leaves, depth = neighbours([c[8 * d :] for c, d in zip(contents, dist.tolist(), strict=True)], group, 8)
    before, common = neighbours([np.frombuffer(c, ">u8", d)[::-1].tobytes() for c, d in zip(contents, dist.tolist(), strict=True)], group, 8)
    lost = np.zeros((size, int(more.max()) + 1), bool)
    node, left = np.empty(size, np.int64), np.empty(size, np.int64)
    for d in range(int((dist - more).min()), int(dist.max()) + 1):
        own = np.flatnonzero((dist - more <= d) & (d <= dist))
        if len(own) < 2:
            continue
        node[leaves] = np.cumsum(depth < width - d)  # the inner node (or leaf) at this depth above each suffix
        left[before] = np.cumsum(common < d)  # how its suffixes split by the d words before them
        _, repeat = np.unique(node[own] * (size + 1) + left[own], return_inverse=True)
        least = np.full(repeat.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, repeat, ids[own])
        hit = own[ids[own] > least[repeat]]
        lost[hit, dist[hit] - d] = True
    return lost


def _trees(t: Tree, rows_at_once: int):
    def solve(x: pa.Table) -> pa.RecordBatch:
        prefix, ids, p, skip, more, dist = (x.column(c).to_numpy() for c in ("prefix", "id", "p", "skip", "more", "dist"))
        row, a, z = stretches(subtrees(prefix, ids, more, dist, x.column("content").to_pylist(), t.width), t.width)
        return pa.RecordBatch.from_arrays([*[pa.array(x.column(c).to_numpy()[row]) for c in (*OWNER, "p")], pa.array(skip[row] + a), pa.array(skip[row] + z)], names=[*OWNER, "p", "a", "z"])

    return by_group(solve, "prefix", rows_at_once)


def _whole_windows(t: Tree):
    """(node, owner, suffix, window) of every window: its whole content is the prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prefix, skip, more, dist = (b.column(c).to_numpy() for c in ("prefix", "skip", "more", "dist"))
            nodes = []
            for i, c in enumerate(b.column("content").to_pylist()):
                sums, k = prefix_sums(np.frombuffer(c, ">u8").astype(U)), int(more[i]) + 1
                h = mix((sums[t.width : t.width + k] - sums[:k]) * powers(k, BASE_INV))
                nodes.append(mix(h + np.arange(k, dtype=U) - U(int(dist[i])) + prefix[i].view(U)))
            if nodes:
                row = np.repeat(np.arange(len(nodes)), more + 1)
                a = skip[row] + np.concatenate([np.arange(m + 1) for m in more.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes).view(np.int64)), *[b.column(c).take(pa.array(row)) for c in (*OWNER, "p")], pa.array(a)], names=["node", *OWNER, "p", "a"])

    return run


SPANS = "id long, h1 long, h2 long, p long, a long, z long"


def repeated_spans(base: DataFrame, t: Tree, steps: tuple[int, ...], group_most: int, broadcast_rows: int) -> DataFrame:
    """(id, h1, h2, spans) of every text of ``base`` (id, h1, h2, text) with words to lose."""
    spark = base.sparkSession
    rows = arrow_map(base.select(*OWNER, "text"), _prefixes(t), "prefix long, around long, id long, h1 long, h2 long, p long")
    repeated = keep(rows.select("prefix").groupBy("prefix").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("prefix"), "repeated")
    release(spark)
    live = keep(rows.join(modest(repeated, broadcast_rows), "prefix", "left_semi"), "live")
    discard(repeated)
    kinds = keep(live.groupBy("prefix", "around").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*OWNER, "p")).alias("first")), "kinds")
    several = kinds.groupBy("prefix").agg(F.count(F.lit(1)).alias("under")).filter("under > 1")
    inner = keep(kinds.join(several, "prefix").select("prefix", "around", "n", "under", "first.*"), "inner")
    whole = join_all(live, kinds.filter("n > 1").select("prefix", "around", "n", F.col("first.id").alias("least")), ["prefix", "around"], broadcast_rows).filter("id > least")
    whole = whole.select(*OWNER, start_of().alias("a"), (start_of() + more_of() + t.width).alias("z"))

    lists = keep(inner.groupBy(*OWNER).agg(F.collect_list(F.struct("prefix", "p", "under")).alias("items")), "lists")  # of one document's own suffixes
    some = base.join(modest(lists.select("h1").distinct(), broadcast_rows), "h1", "left_semi").select(*OWNER, "text").join(lists, list(OWNER)).dropDuplicates(list(OWNER))
    level = keep(arrow_map(some, _fetch(t), f"{GROWN}, under long"), "suffixes")
    made, compared = [level], []
    release(spark)
    for step in (*steps, 1):
        fits = level.filter(F.col("under") <= group_most).drop("under")
        compared.append(arrow_map(fits.repartition("prefix").sortWithinPartitions("prefix"), _trees(t, 2 * group_most), SPANS))
        crowded = level.filter(F.col("under") > group_most).drop("under")  # their prefix grows
        if crowded.isEmpty():
            break
        if step == 1:
            nodes = arrow_map(crowded, _whole_windows(t), "node long, id long, h1 long, h2 long, p long, a long")
            least = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
            compared.append(join_all(nodes, least, ["node"], broadcast_rows).filter("id > least").select(*OWNER, "p", "a", (F.col("a") + t.width).alias("z")))
            break
        grown = keep(arrow_map(crowded, _longer(t, step), GROWN), "grown")
        still = grown.groupBy("prefix").agg(F.count(F.lit(1)).alias("under")).filter(F.col("under") > group_most)
        level = keep(grown.join(modest(still, broadcast_rows), "prefix", "left").withColumn("under", F.coalesce("under", F.lit(1).cast("long"))), "suffixes")
        discard(grown)
        made.append(level)
    ends = compared[0]
    for more in compared[1:]:
        ends = ends.unionByName(more)
    ends = keep(ends, "ends")
    # the compared suffix stands for every other one with its surroundings in its document
    stands = inner.filter("n > 1").select("prefix", "around", "id", F.struct("h1", "h2", "p").alias("own"))
    twins = live.join(stands, ["prefix", "around", "id"]).filter(F.struct("h1", "h2", "p") != F.col("own")).select(*OWNER, "p", "own").distinct()
    twins = twins.join(ends.select("id", F.struct("h1", "h2", "p").alias("own"), "a", "z"), ["id", "own"]).select(*OWNER, "p", "a", "z")
    ends_at = ends.unionByName(twins).select(*OWNER, (start_of() + F.col("a")).alias("a"), (start_of() + F.col("z")).alias("z"))
    found = gathered([whole, ends_at], list(OWNER))
    discard(live, kinds, inner, lists, ends, *made)
    return found


def _cut(digest: bool):
    def cut(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
        words = text.split()
        n, at, kept = len(words), 0, []
        for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
            kept += words[at:a]
            at = z
        kept += words[at:]
        rest = b" ".join(kept)
        return n, n - len(kept), hashlib.sha256(rest).hexdigest() if digest else rest.decode("utf-8")

    return cut


def dedup_words(docs: DataFrame, width: int = 50, reach: int = 24, gram: int = 4, steps: tuple[int, ...] = (6,), digest: bool = False, group_most: int = 1_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``_row`` (the document's other columns), n_words, n_removed and ``kept`` (remaining words joined by one space), or ``kept_sha256`` instead with ``digest``."""
    t = Tree(width, min(reach, width - gram + 1), gram)
    fields = "n_words bigint, n_removed bigint, " + ("kept_sha256 string" if digest else "kept string")
    return remove(docs, lambda base: repeated_spans(base, t, steps, group_most, broadcast_rows), list(OWNER), _cut(digest), fields, broadcast_rows)
