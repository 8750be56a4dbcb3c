"""Benchmark decontamination by spaced-seed hashing.

Tokens are maximal runs of letters and digits (every byte from x80 on counts as
a letter), A-Z lower-cased. A mask such as ``11011011`` hashes the tokens under
its ones and ignores those under its zeros, so a seed still hits where ignored
tokens were substituted. Seeds of all masks are taken at every position of
every benchmark item and every document; equal hashes are joined, and each hit
fixes a diagonal (document position minus item position) along which the whole
item is compared token by token. A document is contaminated by an item if some
stretch of ``min(stretch, item length)`` aligned tokens agrees in at least
``agree`` of its tokens.

The masks are chosen so that no loss is left at the default limits: every way
to substitute a fifth of 15 to 20 tokens leaves a place where some mask meets
none of them (a test enumerates all). Items of fewer tokens are seeded by a solid mask,
as long as the run of equal tokens that must remain.

The benchmark is the stated query set: it is read in blocks of at most
``block_tokens`` tokens, so what is sent to the executors has that bound however
large the benchmark is, and all documents meet every block.

Defined results: null and empty texts or items never match; an item of fewer
than ``least_tokens`` tokens says nothing about contamination (any text holds
it) and is left out; repeated document rows count once per item; of two
diagonals that agree equally the earlier in the document is told; rows without
a doc_id may be told (as null) but are never removed; empty tables give an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, docs_of, without
from .wordhash import _LOWER, BASE_INV, U, mix, powers, row_blocks, text_bytes

#: Seeds of weight 6.
MASKS = ("111111", "1111011", "110100010011", "1000101000111")
SHORT = 15
_TOKEN = np.ones(256, bool)
_TOKEN[[x for x in range(128) if not chr(x).isalnum()]] = False
OUT = "doc_id long, item_id long, doc_start long, item_start long, n_aligned long, n_equal long"


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, offsets by row) of a block."""
    n = len(data)
    solid = np.zeros(n + 1, bool)
    solid[:n] = _TOKEN[data]
    before = np.zeros(n + 1, bool)
    before[1:] = solid[:-1]
    before[offsets] = False
    starts = np.flatnonzero(solid & ~before)
    stop = ~solid
    stop[offsets] = True
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    sums = np.zeros(n + 1, U)
    np.cumsum(_LOWER[data] * powers(n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(n + 1, BASE_INV)[starts]), np.searchsorted(starts, offsets)


def seeds_of(tokens: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash at every position where the mask's whole span fits."""
    span = len(mask.rstrip("0"))
    n = len(tokens) - span + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, len(mask), U)
    for j, bit in enumerate(mask):
        if bit == "1":
            out = out * U(0x9E3779B97F4A7C15) + tokens[j : j + n]
    return mix(out ^ U(int(mask, 2)))


def solid_mask(n: int, agree: float) -> str:
    """The run of equal tokens that ``n`` tokens hold for certain if ``agree`` of them are equal."""
    wrong = n - math.ceil(agree * n - 1e-9)
    return "1" * -(-(n - wrong) // (wrong + 1))


class Block:
    """Items of one block: their tokens, and the sorted seeds of every mask with item and position."""

    def __init__(self, ids: list[int], texts: list[str], masks: tuple[str, ...], agree: float = 0.8, least_tokens: int = 5):
        data, offsets = text_bytes(pa.array(texts, pa.string()))
        lo = offsets[0]
        tokens, by = tokens_of(data[lo : offsets[-1]], offsets - lo)
        self.ids, self.tokens = ids, [tokens[a:b] for a, b in zip(by[:-1], by[1:], strict=True)]
        short = {n: solid_mask(n, agree) for n in {len(t) for t in self.tokens} if least_tokens <= n < SHORT}
        self.masks = tuple(dict.fromkeys([*masks, *short.values()]))
        self.seeds = []
        for mask in self.masks:
            own = [seeds_of(t, mask) if (mask in masks and len(t) >= SHORT) or short.get(len(t)) == mask else np.zeros(0, U) for t in self.tokens]
            h = np.concatenate(own) if own else np.zeros(0, U)
            item = np.repeat(np.arange(len(own)), [len(x) for x in own])
            at = np.concatenate([np.arange(len(x)) for x in own]) if own else item
            order = np.argsort(h)
            near = np.zeros(1 << 20, bool)
            near[(h >> U(44)).astype(np.int64)] = True
            self.seeds.append((h[order], item[order], at[order], near))


def agreement(item: np.ndarray, doc: np.ndarray, diagonal: int, stretch: int, agree: float) -> tuple[int, int, int, int] | None:
    """(document start, item start, aligned, equal) of the best stretch on a diagonal if it agrees enough."""
    a, b = max(0, -diagonal), min(len(item), len(doc) - diagonal)
    need = min(stretch, len(item))
    if b - a < need:
        return None
    same = item[a:b] == doc[a + diagonal : b + diagonal]
    sums = np.concatenate([[0], np.cumsum(same)])
    best = sums[need:] - sums[:-need]
    if best.max() < agree * need - 1e-9:
        return None
    return a + diagonal, a, b - a, int(sums[-1])


def _search(block: Block, tokens: np.ndarray, by: np.ndarray, stretch: int, agree: float) -> Iterator[tuple[int, int, int, int, int, int]]:
    hits = []
    for mask, (h, item, at, near) in zip(block.masks, block.seeds, strict=True):
        own = seeds_of(tokens, mask)
        if not len(own) or not len(h):
            continue
        maybe = np.flatnonzero(near[(own >> U(44)).astype(np.int64)])
        left, right = np.searchsorted(h, own[maybe], "left"), np.searchsorted(h, own[maybe], "right")
        many = right - left
        pos = np.repeat(maybe, many)
        k = np.repeat(left, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        row = np.searchsorted(by, pos, side="right") - 1
        hits.append(np.stack([row, item[k], pos - by[row] - at[k]], 1))
    if not hits:
        return
    best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
    for row, item, diagonal in np.unique(np.concatenate(hits), axis=0).tolist():
        found = agreement(block.tokens[item], tokens[by[row] : by[row + 1]], diagonal, stretch, agree)
        if found and (found[3], -found[0]) > (best[row, item][3], -best[row, item][0]) if (row, item) in best else found:
            best[row, item] = found
    for (row, item), found in best.items():
        yield row, block.ids[item], *found


def contamination(docs: DataFrame, benchmark: DataFrame, stretch: int = 20, agree: float = 0.8, masks: tuple[str, ...] = MASKS, block_tokens: int = 1_000_000, least_tokens: int = 5) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, n_aligned, n_equal (in tokens; the best diagonal of each pair) for every contaminated pair."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null and text <> ''")
    bytes_in = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-bytes_in // (4 * block_tokens)))  # a token and its separator take two bytes at least, five or six on average
    found = []
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").toArrow()
        held = spark.sparkContext.broadcast(Block(part["item_id"].to_pylist(), part["text"].to_pylist(), masks, agree, least_tokens))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = held.value
            for b in batches:
                data, offsets = text_bytes(b.column("text"))
                rows = []
                for first, last in row_blocks(offsets):
                    lo, hi = offsets[first], offsets[last]
                    tokens, by = tokens_of(data[lo:hi], offsets[first : last + 1] - lo)
                    rows += [(r + first, *x) for r, *x in _search(block, tokens, by, stretch, agree)]
                if rows:
                    row, *rest = (np.array(x) for x in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), *map(pa.array, rest)], names=["doc_id", "item_id", "doc_start", "item_start", "n_aligned", "n_equal"])

        found.append(arrow_map(docs_of(docs), run, OUT))
    return reduce(DataFrame.unionByName, found).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, broadcast_ids: int = 1_000_000, **options) -> DataFrame:
    """The documents (all their columns) that no benchmark item contaminates. The contaminated ids are written once and anti-joined."""
    return without(docs, contamination(docs, benchmark, **options).select("doc_id"), "leaks", broadcast_ids)
