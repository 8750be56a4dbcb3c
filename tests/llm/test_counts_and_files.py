"""Filter audit, collocations and token files against plain Python."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import collocations, filteraudit, tokenfile

SPACE = re.compile("[^\x20\x09-\x0d]+")


# -- filter audit -------------------------------------------------------------


def plain_audit(rows, labels):
    """Every order applied step by step, document by document; Shapley by summing over all orders."""
    quality = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    least: dict = {}
    for d, text, _ in rows:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    docs = []
    for d, text, lang in rows:
        t = text or ""
        words = SPACE.findall(t)
        fails = "".join(
            x
            for x, bad in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and d > least[t]), strict=True)
            if bad
        )
        docs.append((lang or "", fails, d in quality and d is not None, d in toxic and d is not None))
    out = {}
    for part in {x[0] for x in docs}:
        own, removed = [x for x in docs if x[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            gone: set = set()
            for step, f in enumerate(order, 1):
                now = {i for i, x in enumerate(own) if f in x[1] and i not in gone}
                redundant = sum(f in own[i][1] for i in gone)
                gone |= now
                removed[f] += len(now)
                out[part, "".join(order), step] = [len(own) - len(gone), len(now), redundant, sum(x[1] == f for x in own), sum(own[i][2] for i in now), sum(own[i][3] for i in now)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(removed[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_all_orders_applied(spark, texts):
    r = random.Random(3)
    rows = [(i if i % 17 else None, t, r.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [(7, "same text", "en"), (7, "same text", "en"), (3, "same text", "de"), (900, "A B # " * 120, "en"), (901, "A B # " * 120, "fr"), (902, " ".join(map(str, range(300))), "fr")]
    labels = [(i, r.choice([0, 1, None, 2]), r.choice([0, 1])) for i in range(0, 200, 2)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*x, "m", 1) for x in rows], "doc_id long, text string, lang string, mask string, first int").repartition(6)
    got = filteraudit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {(x.part, x.filter_order, x.step): tuple(x[c] for c in COUNTS) for x in got.collect()} == plain_audit(rows, labels)


def test_transform_gives_the_cells_back(spark):
    r = random.Random(4)
    rows = [("p", r.randint(0, 1), r.randint(0, 1), r.choice([0, 3, 5, 6, 7])) for _ in range(500)]
    marked = spark.createDataFrame(rows, "part string, good int, toxic int, mask int")
    cells = filteraudit.cells(filteraudit.parity_sums(marked, 3), 3).first().cells
    assert [(c.mask, c.n, c.good, c.toxic) for c in cells] == [(m, sum(x[3] == m for x in rows), sum(x[3] == m and x[1] == 1 for x in rows), sum(x[3] == m and x[2] == 1 for x in rows)) for m in range(8)]


def test_audit_of_nothing(spark, no_docs):
    assert filteraudit.audit(no_docs, spark.createDataFrame([], "doc_id long, quality int, toxic int")).isEmpty()


# -- collocations -------------------------------------------------------------


def plain_collocations(rows, least, top):
    f, n, out = Counter(), Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    cand = {g: a for g, a in f.items() if len(g[1]) > 1 and a >= least}
    inside = Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                inside[lang, w[i : i + k]] = max(inside[lang, w[i : i + k]], a)
    for lang in n:
        best = []
        for (own, w), a in cand.items():
            if own == lang and not 100 * inside[own, w] >= 80 * a:
                score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
                best.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def phrases(seed):
    r = random.Random(seed)
    words = ["a", "b", "the", "The", "of", "New", "york", "x1", "don't", "é", " ", "日本"]
    return [("".join(r.choice(words) + r.choice([" "] * 8 + ["\t ", ", ", ".", "\n", "  "]) for _ in range(r.randint(0, 60))), r.choice(["en", "en", "de", None])) for _ in range(120)] + [(None, "en"), ("", None), ("...", "de"), ("w w w w w w " * 30, "en"), ("same line here now. " * 40, "fr")]


@pytest.mark.parametrize("slots,hot", [(1 << 12, 250_000), (4, 7), (1, 50)])
def test_collocations_equal_plain_counts(spark, slots, hot):
    """Also where most words share a slot and where each pivot is dealt to many tasks."""
    rows = phrases(slots)
    docs = spark.createDataFrame([(i, t, g, "x", 1) for i, (t, g) in enumerate(rows)], "doc_id long, text string, lang string, phrase string, n int").repartition(5)
    got = collocations.collocations(docs, least=6, top=40, slots=slots, hot=hot, task_words=300)
    assert sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()) == plain_collocations(rows, 6, 40)


def test_long_texts_are_cut_between_pieces_only(monkeypatch):
    data = np.frombuffer(b"ab cd. ef gh ij kl mn op qr st uv wx yz q", np.uint8)
    monkeypatch.setattr(collocations, "BLOCK", 10)
    bounds, rows = collocations._cut(data, np.array([0, len(data)]))
    assert bounds.tolist() == [0, 6, 41] and rows.tolist() == [0, 0]
    assert collocations._cut(data, np.array([0, 3, 3, 6]))[0].tolist() == [0, 3, 3, 6]


def test_arithmetic_passes_64_bits(spark):
    big = 3 * 10**18
    grams = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big), ("en", "b", 1, 2 * big)], "lang string, phrase string, n_words int, n long")
    assert collocations.best_cuts(grams, 2_000_000).first().score == 666_666
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).isEmpty()


# -- token files --------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_files_hold_what_the_library_gives(spark, docs, texts, vocabulary, tmp_path):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(vocabulary)
    where = f"file://{tmp_path}/ids"
    shards = tokenfile.write_ids(docs, vocabulary, where, 2, shard_bytes=3_000)
    got = sorted(tuple(r)[:4] for r in tokenfile.read_ids(shards, batch_bytes=500).collect())
    want, start = [], 0
    for i, t in enumerate(texts):
        ids = np.array([*known.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((3 * i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want and shards.count() > 3
    asked = [0, 30, 99, 100]
    assert {r.doc_id: r.ids for r in tokenfile.fetch(shards, asked).collect()} == {d: [*known.encode(texts[d // 3] or "", add_special_tokens=False).ids, 2] for d in asked if d % 3 == 0}
    assert tokenfile.fetch(shards, []).isEmpty()
    name = next((tmp_path / "ids").glob("dictionary-*"))
    name.write_bytes(name.read_bytes()[:-1] + b"\x00\x01")
    shard = next((tmp_path / "ids").glob("ids-*"))
    tokenfile.ShardReader._known = (b"", None)
    with pytest.raises(ValueError, match="dictionary"):
        tokenfile.ShardReader(f"file://{shard}")
    shard.write_bytes(shard.read_bytes()[:-3])
    with pytest.raises(ValueError, match="complete"):
        tokenfile.ShardReader(f"file://{shard}")


def test_rows_without_id_and_repeated_ids_have_places(spark, vocabulary, tmp_path):
    rows = [(None, "no id"), (5, "b"), (5, "b"), (None, None), (5, "a"), (-1, "x y z")]
    docs = spark.createDataFrame([(*x, 9) for x in rows], "doc_id long, text string, start long")
    got = tokenfile.read_ids(tokenfile.write_ids(docs, vocabulary, f"file://{tmp_path}/i", 2)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, None, -1, 5, 5, 5]
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()


def test_an_empty_table_has_an_empty_manifest(spark, no_docs, vocabulary, tmp_path):
    shards = tokenfile.write_ids(no_docs, vocabulary, f"file://{tmp_path}/e", 2)
    assert shards.isEmpty() and tokenfile.read_ids(shards).isEmpty()


def test_only_the_manifest_makes_files_a_corpus(spark, vocabulary, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string").repartition(4)
    shards = tokenfile.write_ids(docs, vocabulary, f"file://{tmp_path}/m", 2)
    (tmp_path / "m" / "ids-000000-0000-of-a-lost-attempt").write_bytes(b"half a file")
    assert tokenfile.read_ids(tokenfile.manifest(spark, f"file://{tmp_path}/m")).count() == 50 == shards.agg(F.sum("n_docs")).first()[0]


def test_cuts_never_change_ids(texts, vocabulary):
    from tokenizers import Tokenizer

    known, r = Tokenizer.from_file(vocabulary), random.Random(5)
    parts = [" ", "\n", "  ", ".", ",", "?!", "'s", "'", "a", "Word", "héé", "日本", "́", "3", "12.5", ":", "\t", "\n\n", "<|endoftext|>", "|", " ", "Ġ", " Ġx", "İ", "-", " ."]
    tried = texts + ["".join(r.choices(parts, k=r.randint(1, 30))) for _ in range(3_000)]
    got = [x.tolist() for x in tokenfile.id_rows(pa.array(tried, pa.string()), vocabulary, 2)]
    assert got == [[*known.encode(t or "", add_special_tokens=False).ids, 2] for t in tried]


def test_a_dictionary_of_too_few_samples():
    assert tokenfile.train([], 100) == b"" and tokenfile.train([b"abc", b"d"], 3) == b"abc"
