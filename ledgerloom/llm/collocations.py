"""Phrase collocations, mined by pivot partitioning.

1. An Arrow function cuts texts into pieces and words and counts words; Spark
   adds the counts up per language. A fixed-size table of hashed word counts
   (``slots`` whole numbers, whatever the vocabulary) is what the next step
   sends to the executors: a word's entry is its count, or more where words
   share a slot, so that a word with an entry below ``least`` is rare for sure.
2. Words have one order in all tasks: by table entry, then by hash. The pivot of
   an n-gram is its rarest word, the leftmost where that word is repeated. For
   each occurrence of a word that is not rare, its text is rewritten to the
   fragment around it that n-grams of this pivot can come from: at most three
   words to the left that are more frequent, at most three to the right that are
   as frequent or more, within the piece. Equal fragments of a block are one row
   with a count. Rare words end fragments and have none.
3. Fragments are routed by language and pivot. Each task mines what it got,
   pivot by pivot: every n-gram of a fragment that holds the pivot occurrence, so
   each occurrence of an n-gram is counted in one place. A pivot of more than
   ``hot`` occurrences is dealt to several tasks by fragment, so that no task
   holds more of one; its counts are added up once more.
4. n-grams of ``least`` occurrences and more are few. Every candidate is cut in
   every place, the parts' counts are looked up by joins, and the lowest score
   counts; candidates inside a longer one that holds most of their occurrences
   go; each language's first ``top`` are found in two rounds, by salt first.

Arithmetic is in decimals of 38 digits.

Defined results: a null text is empty, a null language ``und``; a text without
words adds nothing; repeated rows count as often as they stand; equal scores
are ordered by count and then by the phrase's bytes; an empty table gives an
empty result. doc_id and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, keep, small_batches
from .wordhash import BASE_INV, U, mix, powers, prefix_sums, row_blocks, text_bytes

LONGEST = 4
BLOCK = 1 << 20
_STOP = np.zeros(256, bool)  # ends a piece
_STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _STOP.copy()  # ends a word
_GAP[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a block of rows: ``data`` holds them lower-cased, each followed by one space; ``starts``, ``ends``, ``hashes`` (of language and word) and ``joined`` (word i + 1 follows in the same piece) by word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        n = len(data)
        solid = ~_GAP[data]
        before = np.zeros(n, bool)
        before[1:] = solid[:-1]
        before[offsets[:-1][offsets[:-1] < n]] = False
        starts = np.flatnonzero(solid & ~before)
        after = np.zeros(n, bool)
        after[:-1] = before[1:] & solid[1:]
        ends = np.flatnonzero(solid & ~after) + 1
        rows = np.searchsorted(offsets, starts, side="right") - 1
        stops = np.zeros(n + 1, np.int64)
        np.cumsum(_STOP[data], out=stops[1:])
        self.lang = langs[rows]
        self.joined = (stops[starts[1:]] == stops[ends[:-1]]) & (rows[1:] == rows[:-1])
        size = ends - starts + 1
        self.ends = np.cumsum(size) - 1
        self.starts = self.ends - size + 1
        at = np.repeat(starts - self.starts, size) + np.arange(int(size.sum()))
        self.data = np.append(_LOWER[data], np.uint8(32))[at]
        self.data[self.ends] = 32
        self.sums = prefix_sums(self.data)
        self.inverse = powers(len(self.data) + 1, BASE_INV)
        self.hashes = mix(self.spans(self.starts, self.ends) + mix(self.lang.astype(U) + U(1)))

    def __len__(self) -> int:
        return len(self.starts)

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of byte ranges of ``data``."""
        return (self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(U)

    def text(self, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        size = ends - starts
        offsets = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(starts - offsets[:-1], size) + np.arange(offsets[-1])
        return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(self.data[at]))


def lang_key(name: str) -> int:
    """A language's number in hashes: the first 8 bytes of a digest of its name, the same in all tasks."""
    import hashlib

    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, row of each part): rows longer than a block are cut after piece ends, which no phrase crosses."""
    bounds, rows = [0], []
    for row, (at, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        while end - at > BLOCK:
            to, stops = at + BLOCK, _STOP[:0]
            while to < end and not len(stops := np.flatnonzero(_STOP[data[max(at, to - BLOCK) : to]])):
                to += BLOCK
            if to >= end:
                break
            at = max(at, to - BLOCK) + int(stops[-1]) + 1
            bounds.append(at)
            rows.append(row)
        bounds.append(end)
        rows.append(row)
    bounds[0] = int(offsets[0])
    return np.array(bounds, np.int64), np.array(rows, np.int64)


def blocks(batch: pa.RecordBatch) -> Iterator[tuple[Words, dict[int, str]]]:
    names = batch.column("lang").dictionary_encode()
    values = names.dictionary.to_pylist()
    keys = np.array([lang_key(v) for v in values], U)
    langs = keys[names.indices.to_numpy(zero_copy_only=False)] if len(values) else np.zeros(0, U)
    data, offsets = text_bytes(batch.column("text"))
    offsets, rows = _cut(data, offsets)
    langs = langs[rows]
    for a, b in row_blocks(offsets, BLOCK):
        w = Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], langs[a:b])
        if len(w):
            yield w, dict(zip(keys.tolist(), values, strict=True))


def _texts(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def _names(keys: np.ndarray, names: dict[int, str]) -> pa.Array:
    known = sorted(names)
    return pa.DictionaryArray.from_arrays(pa.array(np.searchsorted(np.array(known, U), keys).astype(np.int32)), pa.array([names[k] for k in known])).cast(pa.string())


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, phrase, word_hash, n of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w, names in blocks(b):
                hashes, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([_names(w.lang[first], names), w.text(w.starts[first], w.ends[first]).cast(pa.string()), pa.array(hashes.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "phrase", "word_hash", "n"])

    found = arrow_map(_texts(docs), run, "lang string, phrase string, word_hash long, n long", "collocations")
    return found.groupBy("lang", "phrase", "word_hash").agg(F.sum("n").alias("n"))


def slot_table(words: DataFrame, slots: int, least: int) -> np.ndarray:
    """Counts of all words by slot (hash modulo ``slots``); entries below ``least`` stay 0. At most ``slots`` rows come to the driver."""
    found = words.groupBy(F.col("word_hash").bitwiseAND(F.lit(slots - 1)).cast("int").alias("slot")).agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
    table = np.zeros(slots, np.int64)
    table[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return table


def extents(w: Words, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pivot positions, words to the left, words to the right) of the fragments of more than one word."""
    n, reach = len(w), LONGEST - 1
    h = w.hashes
    left, right = np.zeros(n, np.int8), np.zeros(n, np.int8)
    up, down = counts >= least, counts >= least
    for d in range(1, min(reach, n - 1) + 1):
        linked = w.joined[d - 1 :] if d == 1 else linked[:-1] & w.joined[d - 1 :]  # words i and i + d stand in one piece
        near, far = slice(0, n - d), slice(d, n)
        less = (counts[near] < counts[far]) | ((counts[near] == counts[far]) & (h[near] < h[far]))
        same = (counts[near] == counts[far]) & (h[near] == h[far])
        more = np.zeros(n, bool)
        more[far] = linked & ~less & ~same  # the word d to the left is more frequent
        up = up & more
        left[up] = d
        more = np.zeros(n, bool)
        more[near] = linked & (less | same)  # the word d to the right is as frequent or more
        down = down & more
        right[down] = d
    at = np.flatnonzero(left + right)
    return at, left[at].astype(np.int64), right[at].astype(np.int64)


FRAGMENTS = "lang string, route long, parts int, fragment string, left int, n long"


def fragments(docs: DataFrame, table, slots: int, least: int, hot: int) -> DataFrame:
    """lang, route (pivot and, if it is hot, part), parts, fragment, left (words before the pivot), n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for b in batches:
            for w, names in blocks(b):
                counts = known[(w.hashes & U(slots - 1)).astype(np.int64)]
                at, left, right = extents(w, counts, least)
                starts, ends = w.starts[at - left], w.ends[at + right]
                spans = mix(w.spans(starts, ends) + w.hashes[at] * U(5) + left.astype(U))
                _, first, n = np.unique(spans, return_index=True, return_counts=True)
                pivot = at[first]
                parts = -(-counts[pivot] // hot)
                route = mix(w.hashes[pivot] + (spans[first] % parts.astype(U)) * U(0x9E3779B97F4A7C15)).view(np.int64)
                for a in range(0, len(first), 50_000):
                    s = slice(a, a + 50_000)
                    yield pa.RecordBatch.from_arrays([_names(w.lang[pivot[s]], names), pa.array(route[s]), pa.array(parts[s], pa.int32()), w.text(starts[first[s]], ends[first[s]]).cast(pa.string()), pa.array(left[first[s]], pa.int32()), pa.array(n[s], pa.int64())], names=["lang", "route", "parts", "fragment", "left", "n"])

    return arrow_map(_texts(docs), run, FRAGMENTS, "collocations")


def _mine(langs: pa.Array, parts: np.ndarray, texts: pa.Array, left: np.ndarray, n: np.ndarray, least: int) -> pa.RecordBatch:
    """The n-grams of fragments that hold the pivot occurrence, with their counts; of pivots that are whole here only those of ``least`` occurrences."""
    data, offsets = text_bytes(texts)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.sort(np.concatenate([offsets[:-1], gaps + 1])), np.sort(np.concatenate([offsets[1:], gaps]))
    firsts = np.searchsorted(starts, offsets[:-1])
    right = np.diff(np.append(firsts, len(starts))) - left - 1
    names = langs.dictionary_encode()
    codes = names.indices.to_numpy()
    sums, inverse = prefix_sums(data), powers(len(data) + 1, BASE_INV)
    owned = []
    for a in range(LONGEST):
        for b in range(LONGEST - a):
            if a + b:
                row = np.flatnonzero((left >= a) & (right >= b))
                pivot = firsts[row] + left[row]
                owned.append((row, starts[pivot - a], ends[pivot + b], np.full(len(row), a + b + 1, np.int32)))
    row, s, e, size = (np.concatenate(x) for x in zip(*owned, strict=True))
    hashes = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(U) + codes[row].astype(U) * U(0x9E3779B97F4A7C15))
    _, first, place = np.unique(hashes, return_index=True, return_inverse=True)
    total = np.zeros(len(first), np.int64)
    np.add.at(total, place, n[row])
    kept = np.flatnonzero((total >= least) | (parts[row[first]] > 1))
    at, total = first[kept], total[kept]
    length = e[at] - s[at]
    bounds = np.concatenate([[0], np.cumsum(length)]).astype(np.int64)
    text = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds), pa.py_buffer(data[np.repeat(s[at] - bounds[:-1], length) + np.arange(bounds[-1])]))
    return pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(codes[row[at]])), text.cast(pa.string()), pa.array(size[at]), pa.array(total)], names=["lang", "phrase", "n_words", "n"])


def mined(rows: DataFrame, tasks: int, least: int, chunk: int = 200_000) -> DataFrame:
    """lang, phrase, n_words, n of the phrases of 2 to 4 words: each task takes its fragments pivot by pivot, about ``chunk`` rows at a time; the counts of pivots that were dealt to several tasks are added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def done(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(parts).combine_chunks()
            one = lambda c: t.column(c).chunk(0)
            return _mine(one("lang"), one("parts").to_numpy(), one("fragment"), one("left").to_numpy().astype(np.int64), one("n").to_numpy(), least)

        for b in batches:
            route = b.column("route").to_numpy()
            if size >= chunk and b.num_rows:  # up to the end of the pivot that the held rows end with
                rest = np.flatnonzero(route != held[-1].column("route")[-1].as_py())
                cut = int(rest[0]) if len(rest) else b.num_rows
                held.append(b.slice(0, cut))
                if cut == b.num_rows:
                    continue
                yield done(held)
                held, size, b = [], 0, b.slice(cut)
            if b.num_rows:
                held.append(b)
                size += b.num_rows
        if held:
            yield done(held)

    routed = rows.repartition(tasks, "route").sortWithinPartitions("route")
    local = arrow_map(routed, run, "lang string, phrase string, n_words int, n long", "collocations")
    return local.groupBy("lang", "phrase", "n_words").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def big(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def best_cuts(grams: DataFrame, scale: int) -> DataFrame:
    """lang, phrase, n_words, a, l, r, score of every candidate of ``grams`` (all phrases of 1 to 4 words that are frequent enough): the cut with the lowest score, the first of equals."""
    words = F.split("phrase", " ", -1)
    cuts = grams.filter("n_words > 1").select("lang", "phrase", "n_words", F.col("n").alias("a"), words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "n_words", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("_left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("n_words") - F.col("k")), " ").alias("_right"))
    side = lambda key, count: grams.select("lang", F.col("phrase").alias(key), F.col("n").alias(count))
    scored = cuts.join(side("_left", "l"), ["lang", "_left"]).join(side("_right", "r"), ["lang", "_right"])
    score = F.expr(f"cast({scale} as decimal(8,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = scored.withColumn("score", score).groupBy("lang", "phrase", "n_words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    return best.select("lang", "phrase", "n_words", "a", "b.l", "b.r", "b.score")


def swallowed(grams: DataFrame, share: tuple[int, int]) -> DataFrame:
    """lang, phrase, most: the largest count of a longer candidate that holds the phrase's words side by side."""
    words = F.split("phrase", " ", -1)
    longer = grams.filter("n_words > 2").select("lang", "n_words", "n", words.alias("w"))
    inner = [F.when(F.col("n_words") >= at + size - 1 + (at == 1), F.array_join(F.slice("w", at, size), " ")) for size in (2, 3) for at in range(1, LONGEST - size + 2)]
    return longer.select("lang", "n", F.explode(F.array_distinct(F.array_compact(F.array(*inner)))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("most"))


def first_of(rows: DataFrame, top: int, salts: int) -> DataFrame:
    """``rank`` within a language, 1 to ``top``: the first by salt, then the first of those."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("rank") <= top)
    return some.drop("_salt").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)


def collocations(docs: DataFrame, least: int = 30, top: int = 2_000, scale: int = 2_000_000, share: tuple[int, int] = (80, 100), slots: int = 1 << 22, hot: int = 250_000, task_words: int = 500_000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` phrases of 2 to 4 words with at least ``least`` occurrences.

    A candidate inside a longer one that has ``share`` of its occurrences is left
    out. ``slots`` (a power of two) bounds the table that executors get, ``hot``
    is how many occurrences of a pivot one task mines, ``task_words`` about how
    many words come to a mining task.
    """
    spark = docs.sparkSession
    words = keep(word_counts(docs), "words")
    table = slot_table(words, slots, least)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(table.sum()) // task_words))
    sent = spark.sparkContext.broadcast(table)
    phrases = mined(fragments(docs, sent, slots, least, hot), tasks, least)
    single = words.filter(F.col("n") >= least).select("lang", "phrase", F.lit(1).alias("n_words"), "n")
    grams = keep(phrases.unionByName(single), "grams")
    best = best_cuts(grams, scale)
    inside = swallowed(grams, share)
    part, whole = share
    kept = best.join(inside, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (big(F.col("most")) * whole < big(F.col("a")) * part))
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return first_of(kept, top, 64).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, unnest(flatten(list_transform(range(1, 5), lambda k: list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: w[i : i + k - 1])))) AS g FROM w),
f AS (SELECT lang, array_to_string(g, ' ') AS phrase, len(g) AS k, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND f >= 30),
u AS (SELECT lang, phrase, a, k, w, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.a, u.cut, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * u.a) // (x.f + y.f) AS BIGINT) AS score
      FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.w[1:u.cut], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.w[u.cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, a, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda j: array_to_string(w[j : j + m - 1], ' '))))) AS phrase FROM c WHERE k > 2),
m AS (SELECT lang, phrase, max(a) AS most FROM i GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN m USING (lang, phrase) WHERE most IS NULL OR CAST(100 AS HUGEINT) * most < CAST(80 AS HUGEINT) * a),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""
