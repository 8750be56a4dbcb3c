import random

import pytest

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _salt int, _group string, h1 string, rep string"


def make_texts(seed: int = 7, n: int = 160) -> list:
    """Random prose with exact and near copies, shared passages, repeated lines, odd white space, nulls, empties and one long text."""
    r = random.Random(seed)
    words = ["the", "of", "Idiot", "straße", "ÉCOLE", "naïve", "İ", "日本語", "a", "x1", "don't", "<|endoftext|>", "\U0001f600"] + ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(400)]
    prose = lambda k: " ".join(r.choices(words, k=k))
    shared = [prose(90) for _ in range(4)]
    line = prose(12) + " and this is a line of over forty characters"
    out: list = [None, "", " ", "\n\n", "one", "one two", "A\tB\x0bC\x0cD\rE", "  x  y\u0085z", "a" * 900, "ab" * 700, "ab" * 700, "-" * 3000]
    for i in range(n):
        t = prose(r.randint(1, 120))
        if i % 7 == 0:
            t += " " + r.choice(shared) + "\n" + prose(10)
        if i % 5 == 0:
            t += "\n \t" + (line if i % 2 else line.upper().replace("İ", "İ")) + "  \n" + prose(8)
        if i % 6 == 0 and out[-1]:
            t = out[-1]
        if i % 11 == 0 and out[-1]:
            w = out[-1].split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        out.append(t)
    out.append(" ".join(prose(60) for _ in range(400)))
    return out


@pytest.fixture(scope="session")
def texts():
    return make_texts()


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(3 * i, t, "en", f"s{i % 3}", len(t or ""), 1, "g", "h", "r") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
