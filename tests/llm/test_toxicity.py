import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ledgerloom.llm import toxicity


def corpus(n=600):
    r = random.Random(11)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(500)]
    out = []
    for i in range(n):
        w = r.choices(words, k=r.randint(20, 200))
        bad = i % 5 == 0
        if bad:
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = r.choice(["grumbly", "vexnit" + r.choice(words), "Snarkface"])
        out.append((i, " ".join(w), int(bad)))
    return out


#: Clean texts of words, letters and scripts that ``corpus`` does not hold; some share letters with its toxic words.
UNSEEN = (
    "this very line is repeated in six of the documents here",
    "great green gardens grow very big vegetables",
    "Mary Vickers and Gregory Grumman visited Kyiv, Zagreb and Skopje by van, very glad about snacks",
    "my quick brown fox jumps over the lazy dog by the grey bridge, five vexed wizards making gumbo",
    "Мы поехали в город и купили хлеб, молоко и яблоки для семьи",
    "東京の天気は晴れです。明日は雨が降るでしょう。",
    "über Größe müßte man öfter sprechen",
)


def test_clean_texts_of_unseen_words_stay_clean(spark):
    rows = corpus(300)
    clean = [t for _, t, y in rows if not y]
    more = [x for k, t in enumerate(UNSEEN) for x in (t, f"{t} {clean[k]}", f"{clean[20 + k]}\n{t}", " ".join([t] * 8))]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000 + k, t) for k, t in enumerate(more)], "doc_id long, text string")
    got = {r.doc_id: r.predicted for r in toxicity.score(d, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect()}
    assert [more[k] for k in range(len(more)) if got[1000 + k]] == []
    assert sum(got[i] == y for i, _, y in rows) >= 0.98 * len(rows)


@pytest.mark.parametrize("mark", ["。", "\u00a0", "—", "\u2019", ""])
def test_texts_without_ascii_separators_are_read_whole(spark, mark):
    """Ordinary words lead every text, so that nothing toxic is in its first 24 characters."""
    rows = corpus()
    own = [w for _, t, y in rows if not y for w in t.split()]
    letters = {ord(c): chr(0x4E00 + 37 * k) for k, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
    texts = [mark.join([*random.Random(i).choices(own, k=12), *t.lower().split()]).translate(letters) for i, t, _ in rows]
    d = spark.createDataFrame([(i, t) for (i, *_), t in zip(rows, texts, strict=True)], "doc_id long, text string")
    got = [r for r in toxicity.score(d, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")).collect() if r.held_out]
    assert all(r.predicted for r in got if rows[r.doc_id][2])
    assert sum(r.predicted == rows[r.doc_id][2] for r in got) / len(got) >= (0.97 if mark else 0.9)


def test_every_character_of_a_long_run_is_in_a_word():
    for n in (24, 25, 26, 27, 28, 29, 61, 1000):
        text = "".join(chr(0x4E00 + k) for k in range(n))
        words = toxicity.words_of(text)
        assert all(any(text[k : k + 5] in w for w in words) for k in range(n - 4))
    assert toxicity.words_of("naïve—«Straße»\u3000語。हिन्दी") == ["naïve", "straße", "語", "हिन्दी"]


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9001, None), (9002, ""), (9003, "!!"), (None, "grumbly snarkface"), (0, rows[0][1])], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(0, 1, None), (None, 0, 1), (77777, 0, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.score(d, labels).collect()
    assert len(got) == len(rows) + 5
    by = {r.doc_id: r for r in got}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by[i].held_out == (i in set(held)) for i, _, _ in rows)
    assert sum(by[i].predicted == rows[i][2] for i in held) / len(held) >= 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert by[9001].score == by[9002].score == by[9003].score < 0.3 < by[None].score


def test_labels_of_the_held_out_remainder_are_never_read(spark):
    rows = corpus(300)
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    score = lambda flip: {r.doc_id: r.score for r in toxicity.score(d, spark.createDataFrame([(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, y in rows], "doc_id long, toxic int")).collect()}
    assert score(False) == score(True)


def test_no_labels_or_documents(spark, no_docs, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(no_docs, none).count() == 0
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}


class PlainKneserNey:
    """Class-conditional Kneser-Ney with shared continuation counts, by the book: dictionaries, one n-gram at a time."""

    def __init__(self, counts, order, discount):
        self.order, self.d = order, discount
        self.top = [defaultdict(int), defaultdict(int)]
        for c, words in enumerate(counts):
            for w, n in words.items():
                w = f"^{w}$"
                for k in range(1, len(w)):
                    self.top[c][w[max(0, k - order + 1) : k + 1]] += n
        types = set(self.top[0]) | set(self.top[1])
        self.seen, level = types, {g for g in types if len(g) == order}
        self.types = {}
        for k in range(order, 1, -1):  # how many longer types each shorter n-gram ends
            self.types[k - 1] = Counter(g[1:] for g in level)
            level = set(self.types[k - 1]) | {g for g in types if len(g) == k - 1}
        self.letters = sorted(self.types[1])

    def shared(self, gram):
        if not gram:
            return 1 / len(self.letters)
        below = self.shared(gram[1:])
        own = {g: n for g, n in self.types[len(gram)].items() if g[:-1] == gram[:-1]}
        total = sum(own.values())
        return (max(own.get(gram, 0) - self.d, 0) + self.d * len(own) * below) / total if total else below

    def p(self, c, gram):
        own = {g: n for g, n in self.top[c].items() if len(g) == len(gram) and g[:-1] == gram[:-1]}
        total = sum(own.values())
        below = self.shared(gram[1:])
        return (max(own.get(gram, 0) - self.d, 0) + self.d * len(own) * below) / total if total else below


@pytest.mark.parametrize("order", [3, 5])
def test_likelihoods_equal_plain_kneser_ney_whose_probabilities_sum_to_one(order):
    r = random.Random(order)
    words = ["".join(r.choices("abcé", k=r.randint(1, 7))) for _ in range(60)]
    counts = tuple(Counter({w: r.randint(1, 9) for w in r.sample(words, 40)}) for _ in range(2))
    plain = PlainKneserNey(counts, order, 0.75)
    for c in (0, 1):
        for history in {g[:-1] for g in plain.seen} | {"^zzzz"[:order - 1], "q"}:
            assert abs(sum(plain.p(c, history + x) for x in plain.letters) - 1) < 1e-9
    every = sorted(counts[0].keys() | counts[1].keys())
    parts = [(part, np.array([[c[w] for c in counts] for w in part], float)) for part in (every[:20], every[20:])]
    keys, log_p, n = toxicity.likelihoods(parts, order)
    assert len(keys) == len(plain.seen)
    points = {}
    for g in plain.seen:
        own = np.array([ord(x) for x in g], np.uint64)
        points[int(toxicity.gram_keys(own, np.zeros(len(own), np.int64), order)[-1])] = g
    for key, lp, m in zip(keys.tolist(), log_p, n, strict=True):
        g = points[key]
        assert [plain.top[c].get(g, 0) for c in (0, 1)] == m.tolist()
        assert all(abs(math.exp(lp[c]) - plain.p(c, g)) < 1e-9 for c in (0, 1))
    ratio = toxicity.kneser_ney(counts, order).seen
    for key, value in zip(ratio.keys.tolist(), ratio.values.tolist(), strict=True):
        g = points[key]
        want = math.log(plain.p(1, g) / plain.p(0, g))
        want = min(want, 0) if not plain.top[1].get(g) else max(want, 0) if not plain.top[0].get(g) else want
        assert abs(value - want) < 1e-5


def test_signs_of_words():
    counts = (Counter({"abab": 5, "abc": 3, "cab": 2}), Counter({"abab": 1, "bad": 4}))
    m = toxicity.kneser_ney(counts, order=3)
    assert m.word("bad") > 1 and m.word("abc") < 0 and math.isfinite(m.word("zzz"))
    m2 = toxicity.kneser_ney((counts[0], counts[0]), order=3)
    assert all(abs(m2.word(w)) < 1e-9 for w in ("abab", "zz", "cab"))


def test_long_texts_clashing_names_and_repeated_rows(spark):
    rows = corpus(300)
    clean = " ".join(t for _, t, y in rows if not y)
    long = " ".join([clean] * 20)
    more = [(1001, long), (1002, long + " grumbly snarkface vexnit grumbly snarkface"), (1003, "x" * 200_000), (1004, rows[0][1]), (1004, rows[0][1])]
    d = spark.createDataFrame([(i, t, 1, "s", 2, 3) for i, t in [(i, t) for i, t, _ in rows] + more], "doc_id long, text string, score int, word string, toxic int, top int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = [r for r in toxicity.score(d, labels).collect()]
    by = {r.doc_id: r for r in got}
    assert len(long) > 1_000_000 and by[1001].predicted == 0 and by[1003].predicted == 0
    assert by[1002].score > by[1001].score
    assert len({r.score for r in got if r.doc_id == 1004}) == 1 and sum(r.doc_id == 1004 for r in got) == 2
    kept = toxicity.drop_toxic(d, labels)
    assert kept.columns == d.columns and {r.score for r in kept.select("score").collect()} == {1}


def test_a_text_too_long_for_the_sample_is_passed_over(spark):
    rows = corpus(300)
    d = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9000 + i, rows[0][1] * 3_000) for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(9000 + i, 0) for i in range(12)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(d, labels, sample_bytes=400_000).collect()}
    assert sum(got[i] == y for i, _, y in rows) >= 0.97 * len(rows)
