"""Toxicity by class-conditional Kneser-Ney models.

Two character models, one of toxic and one of ordinary texts, predict each
character of a word from up to ``order - 1`` characters before it in the word.
Each class has its own absolute-discounted counts at the highest order; all
lower orders are continuation counts pooled over both classes, so what is rare
is smoothed alike and leaves only the difference the classes really show. The
smaller class gives more mass to what it has not seen, which says nothing about
a text: an n-gram never seen in toxic texts does not speak for them, one never
seen in ordinary texts not against, and one never seen at all is neutral. So a
text's log-likelihood ratio needs one table by n-gram.

One rare letter is not a toxic word: what speaks for toxicity in a word counts
in so far as toxic texts hold most of its n-grams, by the share they hold less
the share they do not (nothing if that is below zero). A word of a new topic,
name or language that meets a toxic word in a few letters so stays neutral.

A text's features are length-normalised log-likelihood ratios: per character
over the whole text, per word in its highest word, its highest four-word window
and its three highest words, and the share of words with a high ratio; with them
goes the logarithm of the number of words, as a long text has higher extremes by
chance. A logistic calibration maps them to a score.

Labels are learnt from where crc32(doc_id as text) mod 4 is 0, 1 or 3; remainder
2 is never read. The calibration sees each labelled text under models of the
other two remainders (cross-fitting); the final models learn from all three.

The training sample is bounded: at most ``sample_rows`` labelled rows in order
of a hash, and of these as many as fit in ``sample_bytes`` of text. Scoring
covers every whole text: a run of more than 24 characters without a separator,
as in scripts without spaces, is read whole as overlapping parts.

Defined results: a null or empty text (or one without a word) scores as a text
of ratio zero; a document labelled twice counts as toxic if either label says
so; without labels of both classes every score is 0; repeated rows each give a
row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, docs_of, release, rowed, unrowed
from .wordhash import U, mix

#: Beyond ASCII, punctuation, separators, controls and the zero-width space end a word; marks, symbols and letters of all scripts are in it.
_ENDS = "".join(chr(x) for x in range(0x80, 0x20000) if unicodedata.category(chr(x)) in ("Cc", "Pc", "Pd", "Pe", "Pf", "Pi", "Po", "Ps", "Zl", "Zp", "Zs") or x == 0x200B)
WORD = re.compile(r"(?:[a-z0-9]+|[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f" + re.escape(_ENDS) + "]+)+")
ASCII_WORD = re.compile("[a-z0-9]+")
#: A longer run of characters, as in scripts without spaces, is read as words of ``PART`` characters, one every ``STEP``.
LONGEST, PART, STEP = 24, 6, 2
FEATURES = ("per_char", "word", "window", "top", "words", "strong")
FOLDS = (0, 1, 3)
#: A word counts as strong above this log-likelihood ratio.
STRONG = 3.0


def words_of(text: str) -> list[str]:
    """The words of a text, in order; every character is in one."""
    out = []
    text = text.lower()
    for w in (ASCII_WORD if text.isascii() else WORD).findall(text):
        if len(w) <= LONGEST:
            out.append(w)
        else:
            out += [w[at : at + PART] for at in range(0, len(w) - PART + STEP, STEP)]
    return out


def fold_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def gram_keys(points: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """64-bit key of the up to ``order`` characters that end at each position and do not begin before ``starts``."""
    at = np.arange(len(points))
    out = np.zeros(len(points), U)
    for k in range(order - 1, -1, -1):
        inside = at - k >= starts
        out = np.where(inside, out * U(0x9E3779B97F4A7C15) + points[np.maximum(at - k, 0)] + U(1), out)
    return mix(out)


def _points(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points of all words as ^word$, start of the own word at each, word offsets)."""
    points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), np.uint32).astype(U)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return points, np.repeat(offsets[:-1], sizes), offsets


class Table:
    """Sorted 64-bit keys with values: 12 bytes an entry."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values.astype(np.float32)


def _find(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted ``known``, found)."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


@dataclass
class Ratios:
    """Log-likelihood ratios, toxic over ordinary, of characters and so of words."""

    seen: Table
    toxic: np.ndarray  # of each of the table's keys, whether toxic texts hold it
    order: int

    def words(self, words: list[str]) -> np.ndarray:
        points, starts, offsets = _points(words)
        at, found = _find(self.seen.keys, gram_keys(points, starts, self.order))
        found[offsets[:-1]] = False
        value, known = np.zeros(len(at)), np.zeros(len(at))
        value[found], known[found] = self.seen.values[at[found]], self.toxic[at[found]]
        share = np.add.reduceat(known, offsets[:-1]) / (np.diff(offsets) - 1)
        speaks = np.add.reduceat(np.maximum(value, 0), offsets[:-1])
        return speaks * np.maximum(2 * share - 1, 0) + np.add.reduceat(np.minimum(value, 0), offsets[:-1])

    def word(self, w: str) -> float:
        return float(self.words([w])[0])

    def features(self, texts: list[str]) -> np.ndarray:
        """(texts, features); each distinct word of the texts is scored once."""
        out = np.zeros((len(texts), len(FEATURES)))
        place: dict[str, int] = {}
        rows = [[place.setdefault(w, len(place)) for w in words_of(t)] for t in texts]
        if not place:
            return out
        ratio = self.words(list(place))
        length = np.fromiter(map(len, place), np.int64, len(place)) + 1
        for i, at in enumerate(rows):
            if not at:
                continue
            at = np.array(at)
            v = ratio[at]
            sums = np.concatenate([[0.0], np.cumsum(v)])
            k = min(4, len(v))
            top = np.partition(v, len(v) - min(3, len(v)))[-3:]
            out[i] = sums[-1] / length[at].sum(), v.max(), (sums[k:] - sums[:-k]).max() / 4, top.sum() / 3, math.log1p(len(v)), (v > STRONG).mean()
        return out


def _key_of(window: np.ndarray, first: int, end: int) -> np.ndarray:
    """Keys of the characters in columns ``first`` to ``end`` (excluded), as ``gram_keys`` makes them."""
    out = np.zeros(len(window), U)
    for c in range(first, end):
        out = out * U(0x9E3779B97F4A7C15) + window[:, c].astype(U) + U(1)
    return mix(out)


def _grams(words: list[str], counts: np.ndarray, order: int) -> tuple[np.ndarray, ...]:
    """(key, last ``order`` characters, length, count by class) of the distinct n-grams of words that occur ``counts`` (words, 2) times."""
    points, starts, _ = _points(words)
    at = np.arange(len(points))
    inside = np.flatnonzero(at > starts)
    own = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 2)[inside]
    keys, first, inverse = np.unique(gram_keys(points, starts, order)[inside], return_index=True, return_inverse=True)
    pos = inside[first]
    window = points.astype(np.uint32)[np.maximum(pos[:, None] - np.arange(order - 1, -1, -1), 0)]
    n = np.stack([np.bincount(inverse, counts[own, c], len(keys)) for c in (0, 1)], 1)
    return keys, window, np.minimum(order, pos - starts[pos] + 1).astype(np.int8), n


def _one(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Parts of ``_grams`` as one, each n-gram once."""
    keys, first, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    n = np.concatenate([p[3] for p in parts])
    return keys, np.concatenate([p[1] for p in parts])[first], np.concatenate([p[2] for p in parts])[first], np.stack([np.bincount(inverse, n[:, c], len(keys)) for c in (0, 1)], 1)


def likelihoods(parts: Iterable[tuple[list[str], np.ndarray]], order: int = 5, discount: float = 0.75) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, log-probability of the last character after those before it, count), the last two by class, of every n-gram of ``parts``: (words, counts in the ordinary and the toxic class). Memory follows the distinct n-grams."""
    found: list[tuple[np.ndarray, ...]] = []
    loose = most = 0
    for w, c in parts:
        if w:
            found.append(_grams(w, c, order))
            loose += len(found[-1][0])
        if loose > most:  # what is held stays within a few times the distinct n-grams
            found, loose = [_one(found)], 0
            most = max(200_000, len(found[0][0]))
    keys, window, length, n = _one(found)
    del found

    # Continuation counts, from the longest n-grams down: in how many longer types each one ends, and the sums by history.
    lower: dict[int, tuple[np.ndarray, ...]] = {}
    rows = np.flatnonzero(length == order)
    for k in range(order, 1, -1):
        suffix, rep, types = np.unique(_key_of(window[rows], order - k + 1, order), return_index=True, return_counts=True)
        rep = rows[rep]
        past, back = np.unique(_key_of(window[rep], order - k + 1, order - 1), return_inverse=True)
        lower[k - 1] = suffix, types, past, np.bincount(back, types), np.bincount(back)
        rows = np.concatenate([rep, np.flatnonzero(length == k - 1)])
    letters = max(1, len(lower[1][0]))

    shared = np.full(len(keys), 1 / letters)  # of each n-gram without its first character
    for k in range(1, order):
        own = np.flatnonzero(length > k)
        grams, types, past, totals, kinds = lower[k]
        at, hit = _find(grams, _key_of(window[own], order - k, order))
        h, known = _find(past, _key_of(window[own], order - k, order - 1))
        part = (np.maximum(np.where(hit, types[at], 0) - discount, 0) + discount * kinds[h] * shared[own]) / totals[h]
        shared[own] = np.where(known, part, shared[own])

    before = np.zeros(len(keys), U)
    for k in range(2, order + 1):
        own = length == k
        before[own] = _key_of(window[own], order - k, order - 1)
    histories, back = np.unique(before, return_inverse=True)
    log_p = []
    for c in (0, 1):
        totals, kinds = np.bincount(back, n[:, c]), np.bincount(back, n[:, c] > 0)
        some = totals > 0
        left = np.where(some, discount * kinds / np.where(some, totals, 1), 1.0)
        part = np.maximum(n[:, c] - discount, 0) / np.where(some, totals, 1)[back]
        log_p.append(np.log(part + left[back] * shared))
    return keys, np.stack(log_p, 1), n


def fit(parts: Iterable[tuple[list[str], np.ndarray]], order: int = 5, discount: float = 0.75) -> Ratios:
    """The model from parts of (words, counts in the ordinary and the toxic class)."""
    keys, log_p, n = likelihoods(parts, order, discount)
    ratio = log_p[:, 1] - log_p[:, 0]
    ratio = np.where(n[:, 1] == 0, np.minimum(ratio, 0), np.where(n[:, 0] == 0, np.maximum(ratio, 0), ratio))
    return Ratios(Table(keys, ratio), n[:, 1] > 0, order)


def kneser_ney(counts: tuple[Counter, Counter], order: int = 5, discount: float = 0.75) -> Ratios:
    """The model from word counts of the ordinary (0) and the toxic (1) class."""
    words = sorted(counts[0].keys() | counts[1].keys())
    return fit([(words, np.array([[c[w] for c in counts] for w in words], float))], order, discount)


@dataclass
class Calibration:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([np.ones(len(x)), (x - self.mean) / self.scale]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Calibration:
    """Ridge logistic regression by Newton steps."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w, penalty = np.zeros(z.shape[1]), np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w = w + step
        if abs(step).max() < 1e-8:
            break
    return Calibration(mean, scale, w)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def rows() -> pa.RecordBatch:
        keys = list(counts)
        out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())], names=["toxic", "fold", "word", "n"])
        counts.clear()
        return out

    for b in batches:
        for text, toxic, fold in zip(*(b.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
            counts.update((toxic, fold, w) for w in words_of(text))
            if len(counts) > 300_000:
                yield rows()
    yield rows()


def _features(docs: DataFrame, held) -> DataFrame:
    """``docs`` with the features of its text, all its columns passed on."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 300):
                b = whole.slice(at, 300)
                found = ratios.features([t or "" for t in b.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(found[:, j]) for j in range(len(FEATURES))]], names=[*columns, *FEATURES])

    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in FEATURES]])
    return arrow_map(docs, run, schema)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, sample_bytes: int = 128_000_000, order: int = 5):
    """(broadcast Ratios, Calibration), or None where either class has no label."""
    import pandas as pd  # on the driver only

    spark = docs.sparkSession
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic is not null and doc_id is not null")
    own = own.filter(fold_of(F.col("doc_id")) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).toPandas()  # bounded by sample_rows
    listed = spark.createDataFrame(sample, "doc_id long, toxic int").withColumn("fold", fold_of(F.col("doc_id")).cast("int"))
    texts = docs_of(docs).join(F.broadcast(listed), "doc_id")
    sizes = texts.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("n")).toPandas().set_index("doc_id")["n"]
    room, fits = sample_bytes, []
    for n in sample["doc_id"].map(sizes).fillna(0):  # a text that does not fit is passed over
        fits.append(n <= room)
        room -= n * fits[-1]
    inside = pd.Series(fits, index=sample.index, dtype=bool)
    if not inside.all():
        texts = texts.join(F.broadcast(spark.createDataFrame(sample[inside][["doc_id"]], "doc_id long")), "doc_id", "left_semi")
    found = arrow_map(texts.select("text", "toxic", "fold"), _word_counts, "toxic int, fold int, word string, n long").groupBy("toxic", "fold", "word").agg(F.sum("n").alias("n")).toArrow()  # bounded by sample_bytes
    toxic, fold, n = (found.column(c).to_numpy() for c in ("toxic", "fold", "n"))
    by_class = np.stack([np.where(toxic > 0, 0, n), np.where(toxic > 0, n, 0)], 1).astype(float)

    def model(folds: tuple[int, ...]) -> Ratios:
        own = np.flatnonzero(np.isin(fold, folds))
        return fit(((found.column("word").take(pa.array(own[at : at + 20_000])).to_pylist(), by_class[own[at : at + 20_000]]) for at in range(0, len(own), 20_000)), order)

    parts = []
    for f in FOLDS:
        others = tuple(g for g in FOLDS if g != f)
        if (by_class[np.isin(fold, others)].sum(0) == 0).any():
            return None
        held = spark.sparkContext.broadcast(model(others))
        parts.append(_features(texts.filter(F.col("fold") == f).select("doc_id", "text", "toxic"), held).select("toxic", *FEATURES).toPandas())
        held.destroy()
    points = pd.concat(parts)
    if (points["toxic"] > 0).nunique() < 2:
        return None
    return spark.sparkContext.broadcast(model(FOLDS)), calibrate(points[list(FEATURES)].to_numpy(), (points["toxic"] > 0).to_numpy(float))


def _scored(rows: DataFrame, model) -> DataFrame:
    """``rows`` (with a text) with features and score."""
    if model is None:
        return rows.withColumns({c: F.lit(0.0) for c in (*FEATURES, "score")})
    held, calibration = model
    z = F.lit(float(calibration.weights[0]))
    for c, m, s, w in zip(FEATURES, calibration.mean, calibration.scale, calibration.weights[1:], strict=True):
        z = z + (F.col(c) - float(m)) / float(s) * float(w)
    return _features(rows, held).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0)))))


def _model(docs: DataFrame, labels: DataFrame, options: dict):
    """What ``train`` returns; what it needed on the way is given back."""
    model = train(docs, labels, **options)
    release(docs.sparkSession)
    return model


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted, and the features of every document."""
    scored = _scored(docs_of(docs), _model(docs, labels, options)).drop("text")
    return scored.select("doc_id", (fold_of(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *FEATURES)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """The documents (all their columns) whose score is below ``threshold``."""
    return unrowed(_scored(rowed(docs), _model(docs, labels, options)).filter(F.col("score") < threshold), docs.columns)
