"""Suffix-array dedup of byte strings by prefix-free parsing.

1. **Parse.** A position is a trigger if the rolling hash of the ``gram`` bytes
   there is 0 modulo ``modulus`` (in a window that holds none of these, the place
   of its smallest hash). Triggers cut every text into phrases; each ends with the trigger
   string behind it, so no phrase suffix that holds a trigger string is a prefix
   of another (the set is prefix-free), and equal strings are cut alike wherever
   they stand. A window of ``width`` bytes is a phrase suffix
   of ``d`` bytes before its trigger followed by a suffix of the parse.
2. **Dictionary.** A phrase occurrence whose surroundings occur once holds no
   repeated window. It is known by two hashes: ``k1`` of the ``width - reach``
   bytes that all its windows with ``d`` in one range of ``reach`` share, and
   ``k2`` of all bytes these windows cover. What occurs once by k1 is dropped
   after one count; this is most of a corpus. Occurrences with equal k2 are one
   entry of the dictionary, with their number; the windows of an entry that
   occurs more than once repeat.
3. **Suffix arrays.** Where a k1 has several entries (the ends of repeats) their
   bytes are fetched, one occurrence an entry. In each such group the phrase
   suffixes are ordered from the trigger backwards (equal suffixes of every length
   stand together), the parse suffixes from the trigger forwards, both with the
   lengths of common prefixes. Phrase suffix and rank in the parse together give
   the place of a window in corpus order, and ``d`` plus the common prefix of the
   parse suffixes is what it shares with its neighbour: ``width`` or more is a
   repeat.

The order is made group by group, as equality to ``width`` bytes is all that the
result needs. A group of more than ``group_most`` entries is decided by hashes of
its windows, counted in an aggregation, so no task holds an unbounded group.

Removed is each byte covered by a ``width``-byte string that starts anywhere
else too, in the same document or another; matches never cross documents.

Defined results: a null or empty text has no bytes; what is removed follows from
the texts alone, so doc_ids may be null or repeat; repeated rows repeat all their
strings; bytes are removed as such, so what stays may cut a character and is
returned as binary; an empty table gives an empty result.
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
from .wordhash import BASE_INV, U, mix, powers, prefix_sums, row_blocks, text_bytes


_POS = U((1 << 24) - 1)


@dataclass(frozen=True)
class Parsing:
    width: int
    reach: int
    gram: int
    modulus: int


def phrases(values: np.ndarray, offsets: np.ndarray, q: Parsing) -> tuple[np.ndarray, ...]:
    """(row, start, further windows, distance of the pivot, k1, k2) of every phrase's windows by range of distances; starts count from the row's start."""
    n, width, reach = len(values), q.width, q.reach
    fits = np.flatnonzero(np.diff(offsets) >= width)
    if not len(fits):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U),) * 2
    sums, back = prefix_sums(values), powers(n + 1, BASE_INV)

    def hash_of(a: np.ndarray, z: np.ndarray) -> np.ndarray:
        return mix((sums[z] - sums[a]) * back[a])

    rolling = mix((sums[q.gram :] - sums[: -q.gram]) * back[: n - q.gram + 1])
    whole = width - q.gram + 1  # distances below this leave the trigger string inside the window
    out = []

    def ranges(row: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of the windows from ``first`` to ``last`` before each trigger, by range of distances; returns (row, first, last) of windows that it is too far from."""
        for low in range(0, whole, reach):
            pivot, s, e = at - low, np.maximum(first, at - min(low + reach, whole) + 1), np.minimum(last, at - low)
            some = np.flatnonzero(e >= s)
            pivot, s, e = pivot[some], s[some], e[some]
            k1 = mix(hash_of(pivot, pivot + width - reach) + U(low + salt))
            k2 = mix(hash_of(s, e + width) + U(0xD1342543DE82EF95) * (pivot - s).astype(U) + U(0xC2B2AE3D27D4EB4F) * (e - s).astype(U) + k1)
            out.append((row[some], s - offsets[row[some]], e - s, pivot - s, k1, k2))
        z = np.minimum(last, at - whole)
        some = np.flatnonzero(z >= first)
        return row[some], first[some], z[some]

    at = np.flatnonzero(rolling % U(q.modulus) == 0)
    row = np.searchsorted(offsets, at, side="right") - 1
    inside = at + q.gram <= offsets[row + 1]
    far = n + 2 * width  # one more phrase a row, after its last trigger: no trigger is in its windows' reach
    row, at = np.concatenate([row[inside], fits]), np.concatenate([at[inside], offsets[fits + 1] + far])
    order = np.lexsort((at, row))
    at, row = at[order], row[order]
    first = offsets[row]
    first[1:] = np.where(row[1:] == row[:-1], at[:-1] + 1, first[1:])
    row, first, last = ranges(row, first, np.minimum(at, offsets[row + 1] - width), at, 0)

    if len(row):  # windows without a trigger: the last of their smallest hashes is theirs
        size = last - first + whole
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) + np.repeat(first - (ends - size), size)
        least = (rolling[place] & ~_POS) | (_POS - np.arange(ends[-1], dtype=U))
        span = 1
        while 2 * span <= whole:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[: len(least) - (whole - span)], least[whole - span :]) if span < whole else least
        many = last - first + 1
        of = np.repeat(np.arange(len(row)), many)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = place[(_POS - (least[(ends - size)[of] + nth] & _POS)).astype(np.int64)]
        window = first[of] + nth
        new = np.ones(len(window), bool)
        new[1:] = (at[1:] != at[:-1]) | (of[1:] != of[:-1])
        begin = np.flatnonzero(new)
        ranges(row[of[begin]], window[begin], window[np.append(begin[1:], len(window)) - 1], at[begin], width)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _phrases_of_rows(values: np.ndarray, offsets: np.ndarray, q: Parsing) -> Iterator[tuple[np.ndarray, ...]]:
    """``phrases`` for blocks of any length: a long row is parsed in chunks that overlap by a window."""
    if len(values) <= CHUNK * 2 - q.width:
        yield phrases(values, offsets, q)
        return
    for r in range(len(offsets) - 1):
        own = values[offsets[r] : offsets[r + 1]]
        for at in range(0, max(1, len(own) - q.width + 1), CHUNK):
            part = own[at : at + CHUNK + q.width - 1]
            _, s, *rest = phrases(part, np.array([0, len(part)]), q)
            yield np.full(len(s), r), s + at, *rest


def _parse(q: Parsing):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h1, h2 = b.column("h1").to_numpy(), b.column("h2").to_numpy()
            data, ends = text_bytes(b.column("text"))
            for first, last in row_blocks(ends):
                for row, s, more, dist, k1, k2 in _phrases_of_rows(data[ends[first] : ends[last]], ends[first : last + 1] - ends[first], q):
                    yield pa.RecordBatch.from_arrays([pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(h1[row + first]), pa.array(h2[row + first]), pa.array(pack(s, more, dist))], names=["k1", "k2", "h1", "h2", "p"])

    return run


def _fetch(q: Parsing):
    """The bytes of each listed entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column("items")
            bounds, flat = np.asarray(items.offsets), items.values
            k1, p, n, entries = (np.asarray(flat.field(c)) for c in ("k1", "p", "n", "entries"))
            s, more, _ = unpack(p)
            data, ends = text_bytes(b.column("text"))
            row = np.repeat(np.arange(b.num_rows), np.diff(bounds))
            k1, p, n, entries, s, more = (x[bounds[0] : bounds[-1]] for x in (k1, p, n, entries, s, more))
            a = ends[row] + s
            z = a + more + q.width
            raw = memoryview(data)
            for at in range(0, len(row), 2_000):
                part = slice(at, at + 2_000)
                content = pa.array([bytes(raw[i:j]) for i, j in zip(a[part].tolist(), z[part].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(k1[part]), *[b.column(c).take(pa.array(row[part])) for c in ("h1", "h2")], pa.array(p[part]), pa.array(n[part]), pa.array(entries[part]), content], names=["k1", "h1", "h2", "p", "n", "entries", "content"])

    return run


def corpus_order(k1: np.ndarray, p: np.ndarray, n: np.ndarray, contents: list[bytes], width: int) -> np.ndarray:
    """Repeated windows, a boolean by entry and start within it, of whole groups of equal k1 (sorted by k1)."""
    size = len(k1)
    group = np.concatenate([[0], np.cumsum(k1[1:] != k1[:-1])])
    _, more, dist = unpack(p)
    dictionary, shared_back = neighbours([c[:d][::-1] for c, d in zip(contents, dist.tolist(), strict=True)], group, 1)
    parse, shared_on = neighbours([c[d:] for c, d in zip(contents, dist.tolist(), strict=True)], group, 1)
    repeats = np.zeros((size, int(more.max()) + 1), bool)
    suffix, rank = np.empty(size, np.int64), np.empty(size, np.int64)
    for d in range(int((dist - more).min()), int(dist.max()) + 1):
        own = np.flatnonzero((dist - more <= d) & (d <= dist))
        if len(own) < 2:
            continue
        suffix[dictionary] = np.cumsum(shared_back < d)  # the phrase suffix of d bytes
        rank[parse] = np.cumsum(shared_on < width - d)  # parse suffixes that share the rest of the window
        _, same = np.unique(suffix[own] * (size + 1) + rank[own], return_inverse=True)
        hit = own[np.bincount(same, weights=n[own])[same] >= 2]
        repeats[hit, dist[hit] - d] = True
    return repeats


def _order(q: Parsing, rows_at_once: int):
    def solve(t: pa.Table) -> pa.RecordBatch:
        p = t.column("p").to_numpy()
        row, a, z = stretches(corpus_order(t.column("k1").to_numpy(), p, t.column("n").to_numpy(), t.column("content").to_pylist(), q.width), q.width)
        s = unpack(p)[0][row]
        return pa.RecordBatch.from_arrays([*[pa.array(t.column(c).to_numpy()[row]) for c in ("h1", "h2")], pa.array(s + a), pa.array(s + z)], names=["h1", "h2", "a", "z"])

    return by_group(solve, "k1", rows_at_once)


def _each_window(q: Parsing):
    """(window hash, text, start, end, weight) of every window of the given entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, p, n = (b.column(c).to_numpy() for c in ("k1", "p", "n"))
            s, more, dist = unpack(p)
            found = []
            for i, c in enumerate(b.column("content").to_pylist()):
                sums, k = prefix_sums(np.frombuffer(c, np.uint8)), int(more[i]) + 1
                h = mix((sums[q.width : q.width + k] - sums[:k]) * powers(k, BASE_INV))
                found.append(mix(h + np.arange(k, dtype=U) - U(int(dist[i])) + k1[i].view(U)))
            if found:
                row = np.repeat(np.arange(len(found)), more + 1)
                a = s[row] + np.concatenate([np.arange(m + 1) for m in more.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), *[b.column(c).take(pa.array(row)) for c in ("h1", "h2")], pa.array(a), pa.array(a + q.width), pa.array(n[row])], names=["w", "h1", "h2", "a", "z", "n"])

    return run


def differing(dictionary: DataFrame, broadcast_rows: int, hot: int = 1_000) -> tuple[DataFrame, DataFrame]:
    """(k1, n, entries, h1, h2, p) of the entries whose k1 has several, and the written table of these k1. A k1 of ``hot`` entries and more is sent to them, so no task gets all of its entries."""
    several = keep(dictionary.groupBy("k1").agg(F.count(F.lit(1)).alias("entries")).filter("entries > 1"), "several")
    return join_all(dictionary, several, ["k1"], broadcast_rows, hot, "entries").select("k1", "n", "entries", "at.h1", "at.h2", "at.p"), several


def repeated_spans(base: DataFrame, q: Parsing, group_most: int, broadcast_rows: int) -> DataFrame:
    """(h1, h2, spans) of every text of ``base`` (h1, h2, text) that holds a repeated window."""
    spark = base.sparkSession
    parsed = arrow_map(base.select("h1", "h2", "text"), _parse(q), "k1 long, k2 long, h1 long, h2 long, p long")
    repeated = keep(parsed.select("k1").groupBy("k1").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("k1"), "repeated")
    release(spark)
    live = keep(parsed.join(modest(repeated, broadcast_rows), "k1", "left_semi"), "live")
    discard(repeated)
    dictionary = keep(live.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h1", "h2", "p")).alias("at")), "dictionary")
    ends, several = differing(dictionary, broadcast_rows)
    whole = join_all(live, dictionary.filter("n > 1").select("k1", "k2", "n"), ["k1", "k2"], broadcast_rows)
    whole = whole.select("h1", "h2", start_of().alias("a"), (start_of() + more_of() + q.width).alias("z"))

    lists = keep(ends.groupBy("h1", "h2").agg(F.collect_list(F.struct("k1", "p", "n", "entries")).alias("items")), "lists")  # of one text's own phrases
    some = base.join(modest(lists.select("h1").distinct(), broadcast_rows), "h1", "left_semi").select("h1", "h2", "text").dropDuplicates(["h1", "h2"])
    contents = keep(arrow_map(some.join(lists, ["h1", "h2"]), _fetch(q), "k1 long, h1 long, h2 long, p long, n long, entries long, content binary"), "contents")
    release(spark)
    ordered = arrow_map(contents.filter(F.col("entries") <= group_most).repartition("k1").sortWithinPartitions("k1"), _order(q, 2 * group_most), "h1 long, h2 long, a long, z long")
    each = arrow_map(contents.filter(F.col("entries") > group_most), _each_window(q), "w long, h1 long, h2 long, a long, z long, n long")
    many = each.groupBy("w").agg(F.sum("n").alias("all")).filter("all > 1").select("w")
    found = gathered([whole, ordered, each.join(many, "w", "left_semi").select("h1", "h2", "a", "z")], ["h1", "h2"])
    discard(live, dictionary, several, lists, contents)
    return found


def keep_rest(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    parts, at = [], 0
    for a, z in zip(starts.tolist(), ends.tolist(), strict=True):
        parts.append(text[at:a])
        at = z
    parts.append(text[at:])
    return b"".join(parts)


def _cut(digest: bool):
    def cut(text: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple:
        rest = keep_rest(text, starts, ends)
        return len(text), len(text) - len(rest), len(starts), hashlib.sha256(rest).hexdigest() if digest else rest

    return cut


def dedup_bytes(docs: DataFrame, width: int = 400, reach: int = 192, gram: int = 16, modulus: int = 128, digest: bool = False, group_most: int = 5_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """``_row`` (the document's other columns), n_bytes, n_removed, n_spans and ``kept`` (the remaining bytes), or ``kept_sha256`` instead with ``digest``."""
    q = Parsing(width, min(reach, width - gram + 1), gram, modulus)
    fields = "n_bytes bigint, n_removed bigint, n_spans bigint, " + ("kept_sha256 string" if digest else "kept binary")
    return remove(docs, lambda base: repeated_spans(base, q, group_most, broadcast_rows), ["h1", "h2"], _cut(digest), fields, broadcast_rows)
