import hashlib
import random
import re
from collections import defaultdict

import pytest

from ledgerloom.llm import pfp, substring


def brute_bytes(texts, width):
    starts = defaultdict(int)
    raws = [(t or "").encode() for t in texts]
    for b in raws:
        for i in range(len(b) - width + 1):
            starts[b[i : i + width]] += 1
    out = []
    for b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if starts[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(rest).hexdigest()))
    return out


def brute_words(ids, texts, width):
    first = {}
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for i, w in zip(ids, words, strict=True):
        for k in range(len(w) - width + 1):
            key = tuple(w[k : k + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone[k : k + width] = [True] * width
        out.append((len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def tricky(texts):
    r = random.Random(9)
    extra = ["ab" * 50 + "c" * 70 + "ab" * 55, "c" * 130, "\0" * 120 + "q" + "\0" * 90, " ".join(["go"] * 90), " ".join(["go"] * 61) + " stop", " ".join(["go", "on"] * 40)]
    long = next(t for t in reversed(texts) if t)
    for _ in range(12):
        a = r.randrange(len(long) - 900)
        extra.append(f"x{r.random()} " + long[a : a + r.randint(100, 900)] + f" y{r.random()}")
    return [*texts, *extra, extra[-1]]


@pytest.mark.parametrize(("width", "options"), [(400, {}), (60, {}), (60, {"group_most": 2, "broadcast_rows": 0})])
def test_byte_strings_equal_brute_force(spark, tricky, width, options):
    d = spark.createDataFrame([(3 * i, t, "extra", i) for i, t in enumerate(tricky)], "doc_id long, text string, id string, tag int").repartition(4)
    got = {r._row.doc_id: tuple(r)[1:] for r in pfp.dedup_bytes(d, width=width, reach=min(192, width // 2), digest=True, **options).collect()}
    want = brute_bytes(tricky, width)
    assert got == {3 * i: w for i, w in enumerate(want)}
    assert sum(w[1] for w in want) > 500


@pytest.mark.parametrize(("width", "options"), [(50, {}), (9, {}), (9, {"group_most": 2, "broadcast_rows": 0}), (9, {"group_most": 3, "steps": (2,)}), (9, {"group_most": 0, "steps": (3, 2)})])
def test_word_windows_equal_brute_force(spark, tricky, width, options):
    ids = list(range(0, 3 * len(tricky), 3))
    random.Random(1).shuffle(ids)
    d = spark.createDataFrame(list(zip(ids, tricky, strict=True)), "doc_id long, text string").repartition(4)
    got = {r._row.doc_id: tuple(r)[1:] for r in substring.dedup_words(d, width=width, reach=max(3, width // 2), gram=2, digest=True, **options).collect()}
    want = brute_words(ids, tricky, width)
    assert got == dict(zip(ids, want, strict=True))
    assert sum(w[1] for w in want) > 300


@pytest.mark.parametrize("options", [{}, {"group_most": 1, "broadcast_rows": 0}])
def test_every_copy_in_the_smallest_document_of_a_class_is_cut(spark, options):
    r = random.Random(12)
    new = lambda k: [f"v{r.randint(0, 10**9)}" for _ in range(k)]
    rows = {}
    for n, size in enumerate((52, 60, 75, 140)):
        p, a, b = new(size), new(80), new(80)
        rows[10 * n + 1] = new(70) + p + new(70)
        rows[10 * n + 2] = (new(30) + a + p + b) * 2 + new(20) + a + p + b
        rows[10 * n + 3] = a + p + b
    ids, texts = list(rows), [" ".join(w) for w in rows.values()]
    d = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    got = {x._row.doc_id: tuple(x)[1:] for x in substring.dedup_words(d, digest=True, **options).collect()}
    want = dict(zip(ids, brute_words(ids, texts, 50), strict=True))
    assert got == want
    assert [want[10 * n + 2][1] for n in range(4)] == [3 * 52, 3 * 60, 3 * 75, 3 * 140]


@pytest.mark.parametrize("operator", [pfp, substring])
def test_long_rows_are_chunked(monkeypatch, operator):
    import numpy as np

    r = random.Random(3)
    text = "".join(r.choices("abcd ", k=5000)) + "-" * 700 + "abc" * 300
    text += text[1000:2100]
    values, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])
    monkeypatch.setattr(operator, "CHUNK", 300)
    if operator is pfp:
        parts = list(pfp._phrases_of_rows(values, offsets, pfp.Parsing(60, 30, 8, 32)))
    else:
        parts = list(substring._suffixes_of_rows(values, offsets, substring.Tree(60, 30, 8)))
    assert len(parts) > 10
    starts, more = (np.concatenate([x[k] for x in parts]) for k in (1, 2))
    assert sorted(x for s, m in zip(starts, more, strict=True) for x in range(s, s + m + 1)) == list(range(len(text) - 59))


def test_phrases_are_cut_by_content_and_hold_each_window_once():
    import numpy as np

    r = random.Random(4)
    shared = "".join(r.choices("abcdefgh ", k=900))
    texts = ["".join(r.choices("abcdefgh ", k=r.randint(0, 700))) + shared + "".join(r.choices("xyz", k=50)) for _ in range(5)] + ["", "short", "q" * 1000]
    raw = "".join(texts).encode()
    offsets = np.cumsum([0, *map(len, texts)])
    row, s, more, dist, k1, k2 = pfp.phrases(np.frombuffer(raw, np.uint8), offsets, pfp.Parsing(400, 192, 16, 128))
    seen = sorted((i, x) for i, a, m in zip(row.tolist(), s.tolist(), more.tolist(), strict=True) for x in range(a, a + m + 1))
    assert seen == [(i, x) for i, t in enumerate(texts) for x in range(len(t) - 399)]
    of = {(i, a + j): k for i, a, m, k in zip(row.tolist(), s.tolist(), more.tolist(), k1.tolist(), strict=True) for j in range(m + 1)}
    for j in range(501):  # equal windows lie in phrases of equal k1
        assert len({of[i, texts[i].index(shared) + j] for i in range(5)}) == 1


def test_rows_without_an_id_or_with_a_repeated_one_keep_their_own_spans(spark):
    r = random.Random(14)
    prose = lambda k: " ".join(f"v{r.randint(0, 10**6)}" for _ in range(k))
    shared = prose(120)
    texts = [prose(r.randint(1, 40)) + (" " + shared + " " + prose(3) if i % 9 == 0 else "") for i in range(3_000)]
    d = spark.createDataFrame([(None if i % 2 else 7, i, t) for i, t in enumerate(texts)], "doc_id long, n int, text string").repartition(4)
    got = {x._row.n: tuple(x)[1:] for x in pfp.dedup_bytes(d, digest=True).collect()}
    assert got == dict(enumerate(brute_bytes(texts, 400)))
    got = {x._row.n: tuple(x)[1:] for x in substring.dedup_words(d, digest=True).collect()}
    assert got == dict(enumerate(brute_words([-1 if i % 2 else 7 for i in range(3_000)], texts, 50)))


def test_repeats_nulls_and_empty_tables(spark, no_docs):
    assert pfp.dedup_bytes(no_docs).count() == 0 and substring.dedup_words(no_docs).count() == 0
    long = " ".join(f"w{i}" for i in range(200))
    rows = [(1, long)] * 2 + [(1, "other " + long[::-1]), (None, long), (2, None), (3, ""), (4, long[:300])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r._row.doc_id), r.n_bytes, r.n_removed) for r in pfp.dedup_bytes(d).collect())
    n = len(long)
    assert got == sorted([("1", n, n), ("1", n, n), ("1", n + 6, 0), ("None", n, n), ("2", 0, 0), ("3", 0, 0), ("4", 300, 0)])
    got = sorted((str(r._row.doc_id), r.n_words, r.n_removed) for r in substring.dedup_words(d).collect())
    k = len(long[:300].split())
    assert got == sorted([("1", 200, 200), ("1", 200, 200), ("1", 201, 0), ("None", 200, 0), ("2", 0, 0), ("3", 0, 0), ("4", k, k - 1 if not long[:300].endswith(f"w{k - 1}") else k)])


def test_entries_of_a_crowded_context_are_dealt_over_tasks(spark):
    from pyspark.sql import functions as F

    keys = [1] * 3_000 + [k for k in range(2, 102) for _ in range(2)] + list(range(200, 300))
    rows = [(k, i, 1, (i, i, i)) for i, k in enumerate(keys)]
    d = spark.createDataFrame(rows, "k1 long, k2 long, n long, at struct<h1:long,h2:long,p:long>").repartition(6)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for options in ({}, {"hot": 3_000}):
            ends, _ = pfp.differing(d, 100, **options)
            got = ends.withColumn("task", F.spark_partition_id()).collect()
            assert sorted((r.k1, r.n, r.entries, r.h1, r.h2, r.p) for r in got) == sorted((k, 1, 3_000 if k == 1 else 2, i, i, i) for i, k in enumerate(keys) if k < 200)
            in_task = defaultdict(int)
            for r in got:
                in_task[r.task] += 1
            assert max(in_task.values()) < 1_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
