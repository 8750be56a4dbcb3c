"""Best-fit packing by minimum bin slack.

1. An Arrow function tokenizes every text and returns piece lengths and a
   checksum of the ids, never the ids. The vocabulary's encoder drops white
   space and never looks across it, so a text's ids are the ids of its
   white-space separated words in order; each worker keeps the packed ids of
   recently seen words (bounded, two generations) and calls the library only
   for the others.
2. Only the histogram of piece lengths (at most ``capacity`` rows whatever the
   corpus) reaches the driver. There each bin is filled by a bitset subset-sum
   dynamic programme over the lengths still available; the fullest feasible
   combination is removed, as often in a row as its lengths last.
3. Pieces get a rank within their length (salted, so that one very common
   length is spread over many tasks) and the rank decides sequence and offset.

Defined results: a null or empty text is one piece holding the end id alone;
repeated rows each get their own pieces and places; an empty table gives an
empty result; a text of any length is cut into ``capacity``-token pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CACHES, arrow_map, docs_of, keep
from .tokencount import tokenizer
from .wordhash import U, text_bytes, word_blocks

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


_PLAIN = b"!#$%&()*+,-./:;=?@[]^_`{|}~"


class WordIds:
    """Ids of words, by the 64-bit hash of the word with A-Z lower-cased (the vocabulary lower-cases all text).

    The ids of known words stand one after another in one array; when ``most``
    words are known all is forgotten and learnt anew.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        self.path, self.most = path, most
        self.ends = np.zeros(1 << 17, bool)
        for token, i in tokenizer(path).get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.zeros(0, U), np.zeros(0, np.int32)  # sorted hashes, and the number of each one's word
        self.ids = np.empty(1 << 18, "<u4")
        self.bounds = np.zeros(1 << 16, np.int64)
        self.n = 0

    def add(self, hashes: np.ndarray, ids: np.ndarray, stops: np.ndarray) -> None:
        """Learn words whose ids end at ``stops`` in ``ids``."""
        base, k = int(self.bounds[self.n]), len(hashes)
        while base + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        while self.n + k + 1 > len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
        self.ids[base : base + len(ids)] = ids
        self.bounds[self.n + 1 : self.n + k + 1] = base + stops
        order = np.argsort(hashes)
        at = np.searchsorted(self.keys, hashes[order])
        self.keys, self.place = np.insert(self.keys, at, hashes[order]), np.insert(self.place, at, self.n + order)
        self.n += k

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 if it is new."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.place[at], -1)

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """A run of letters ends in one word-end id, and so does plain punctuation after it: many such words are encoded as one text and told apart by these ids."""
        encode = tokenizer(self.path).encode_batch_fast
        heads = [w.rstrip(_PLAIN) for w in words]
        plain = np.fromiter((h.decode().isalpha() for h in heads), bool, len(heads))
        units = np.fromiter((1 + (len(h) < len(w)) for h, w in zip(heads, words, strict=True)), np.int64, len(heads))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        other = np.flatnonzero(~plain).tolist()
        simple = np.flatnonzero(plain)
        for at in range(0, len(simple), 4_000):
            own = simple[at : at + 4_000]
            ids = np.asarray(encode([b" ".join([words[i] for i in own.tolist()]).decode()], add_special_tokens=False)[0].ids, "<u4")
            stops, last = np.flatnonzero(self.ends[ids]) + 1, np.cumsum(units[own])
            if len(stops) == last[-1] and stops[-1] == len(ids):
                done.append((own, ids, stops[last - 1]))
            else:
                other += own.tolist()
        for at in range(0, len(other), 4_000):
            own = other[at : at + 4_000]
            found = [x.ids for x in encode([words[i].decode() for i in own], add_special_tokens=False)]
            done.append((np.array(own), np.array([i for x in found for i in x], "<u4"), np.cumsum([len(x) for x in found])))
        before = np.cumsum([0, *[len(ids) for _, ids, _ in done]])
        self.add(hashes[np.concatenate([own for own, _, _ in done])], np.concatenate([ids for _, ids, _ in done]), np.concatenate([stops + b for (_, _, stops), b in zip(done, before, strict=False)]))

    def encode(self, data: np.ndarray, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, ids before each word and in all)."""
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.n + len(distinct) > self.most:
            self.forget()
        at = self.known(distinct)
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            raw = data.tobytes()
            self.learn(distinct[fresh], [raw[starts[i] : ends[i]] for i in first[fresh].tolist()])
            at = self.known(distinct)
        begin, size = self.bounds[at], self.bounds[at + 1] - self.bounds[at]
        before = np.concatenate([[0], np.cumsum(size[inverse])])
        return self.ids[np.repeat(begin[inverse] - before[:-1], size[inverse]) + np.arange(before[-1])], before


_ids: dict[str, WordIds] = {}
CACHES["packing"] = _ids.clear


def piece_rows(column: pa.Array, path: str, capacity: int, end_id: int) -> tuple[np.ndarray, ...]:
    """(row, piece, start, length, crc32) of every piece of a batch."""
    known = _ids.setdefault(path, WordIds(path)) if path not in _ids else _ids[path]
    data, offsets = text_bytes(column)
    end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
    out: list[tuple[int, int, int, int, int]] = []
    for first, last, hashes, by_row, starts, ends in word_blocks(column, lower=True, most=1 << 20):
        ids, before = known.encode(data[offsets[first] : offsets[last]], hashes, starts, ends)
        raw = memoryview(ids.astype("<u4").tobytes())
        stops = (4 * before[by_row]).tolist()
        for row, a, b in zip(range(first, last), stops[:-1], stops[1:], strict=True):
            coded = bytes(raw[a:b]) + end
            for k, at in enumerate(range(0, len(coded), step)):
                part = coded[at : at + step]
                out.append((row, k, at // 4, len(part) // 4, zlib.crc32(part)))
    return tuple(np.array(x, np.int64) for x in (zip(*out, strict=True) if out else [[]] * 5))


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, piece, start, length, crc = piece_rows(b.column("text"), tokenizer_path, capacity, end_id)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs_of(docs), run, PIECES, "packing")


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The fullest combination of available lengths that fits and holds the longest one: a subset-sum bitset over bounded multiples, longest first, stopped once the bin can be filled."""
    lengths = sorted((x for x, n in counts.items() if n), reverse=True)
    longest = lengths[0]
    full, reach = (1 << (capacity + 1)) - 1, 1 << longest
    steps: list[tuple[int, int, int]] = []  # (length, multiple, sums reachable before)
    for x in lengths:
        left = min(counts[x] - (x == longest), (capacity - longest) // x)
        many = 1
        while left > 0:
            take = min(many, left)
            steps.append((x, take, reach))
            reach |= (reach << (x * take)) & full
            left -= take
            many *= 2
        if reach >> capacity & 1:
            break
    total, chosen = reach.bit_length() - 1, {longest: 1}
    for x, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[x] = chosen.get(x, 0) + take
            total -= x * take
    return chosen


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rows (length, first rank, end rank, first sequence, pieces a sequence, offset) that tell where the pieces of a length go by rank, and the number of sequences."""
    left, used, rows, sequences = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    while left:
        chosen = fullest(left, capacity)
        times = min(left[x] // n for x, n in chosen.items())
        offset = 0
        for x, n in sorted(chosen.items(), reverse=True):
            rows.append((x, used[x], used[x] + n * times, sequences, n, offset))
            used[x] += n * times
            left[x] -= n * times
            offset += n * x
            if not left[x]:
                del left[x]
        sequences += times
    return rows, sequences


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, rank_group: int = 50_000) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    ``rank_group`` is about how many pieces one task ranks at a time.
    """
    spark = docs.sparkSession
    pieces = keep(pieces_of(docs, tokenizer_path, capacity, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    rows, _ = plan(histogram, capacity)
    table: dict[int, np.ndarray] = {}
    for r in rows:
        table.setdefault(r[0], []).append(r[1:])
    where = spark.sparkContext.broadcast({x: np.array(v, np.int64) for x, v in table.items()})

    salts = max(16, -(-sum(histogram.values()) // rank_group))
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "_salt").count().select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(within).cast("long")).join(firsts, ["length", "_salt"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = where.value
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            order = np.argsort(length, kind="stable")
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
                t = known[int(length[part[0]])]
                t = t[np.searchsorted(t[:, 0], rank[part], side="right") - 1]
                nth = rank[part] - t[:, 0]
                sequence[part] = t[:, 2] + nth // t[:, 3]
                offset[part] = t[:, 4] + nth % t[:, 3] * length[part]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return arrow_map(ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_rank") - 1).alias("_rank")), place, f"{PIECES}, sequence_id long, offset long")
