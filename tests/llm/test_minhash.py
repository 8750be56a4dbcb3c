import random
import re

import numpy as np

from ledgerloom.llm import links, minhash


def word_sets(texts, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute(ids, texts, k, percent=80):
    sets, root = word_sets(texts, k), {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(ids[i]), find(ids[j])))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


def test_near_duplicates_equal_brute_force(spark, docs, texts):
    ids = [3 * i for i in range(len(texts))]
    for k in (2, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, words=k).collect()}
        assert got == brute(ids, texts, k)


def test_one_large_group_of_near_copies_with_unlike_members(spark):
    r = random.Random(5)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(60)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(60)] = f"z{r.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(i, " ".join(base)) for i in range(150, 260)] + [(300, None), (301, ""), (302, "w")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute([i for i, _ in rows], [t for _, t in rows], 2)
    for options in ({}, {"crowd_at": 4}, {"crowd_at": 4, "crowd_shingles": 700}, {"crowd_at": 10**6, "broadcast_ids": 0}):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(d, words=2, **options).collect()}
        assert sum(got[i] != want[i] for i in want) <= 1


def test_nulls_repeats_and_empty(spark, no_docs):
    assert minhash.near_duplicates(no_docs).count() == 0
    d = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "A B c d e f"), (None, "a b c d e f"), (3, None)], "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash.near_duplicates(d).collect()), key=str)
    assert got == sorted([(1, 2, 1, True)] * 3 + [(2, 2, 1, False), (3, 0, 3, True), (None, 2, None, True)], key=str)


def test_pruning_table_keeps_similar_pairs():
    least = minhash.least_matches(192, 0.8, 0.001)
    assert least == sorted(least) and all(m < 0.8 * 16 * (k + 1) for k, m in enumerate(least))
    r = np.random.default_rng(1)
    same = r.random((2000, 192)) < 0.85
    alive = np.ones(2000, bool)
    for k, m in enumerate(least):
        alive &= same[:, : 16 * (k + 1)].sum(1) >= m
    assert alive.mean() > 0.98
    far = r.random((2000, 192)) < 0.5
    alive = np.ones(2000, bool)
    for k, m in enumerate(least):
        alive &= far[:, : 16 * (k + 1)].sum(1) >= m
    assert alive.sum() == 0


def test_pairs_at_the_threshold_are_pruned_as_seldom_as_stated(docs):
    stated = 0.001
    run = minhash.NearDuplicates(docs, 5, 0.8, 32, 6, stated, 64, 2_000_000, 1_000_000)
    alive, lost = np.array([1.0]), 0.0
    for k, m in enumerate(run.least):
        for _ in range(16):
            alive = 0.8 * np.append(0, alive) + 0.2 * np.append(alive, 0)
        lost += alive[:m].sum()
        alive[:m] = 0
        assert k or m > 0
    assert lost <= stated and abs(lost - minhash.loss(run.least, 0.8)) < 1e-9


def test_components_on_paths_stars_and_cliques(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(100, 160)] + [(1000, 1000 + i) for i in range(1, 60)] + [(r.randint(0, 90), r.randint(0, 90)) for _ in range(60)]
    r.shuffle(pairs)
    root = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {x.node: x.component for x in links.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {k: v for k, v in got.items()} == {k: v for k, v in root.items() if k in got} and all(root[k] == k for k in root.keys() - got.keys())


def test_components_of_links_known_in_part(spark):
    make = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    first = links.components(make([(1, 2), (5, 6), (9, 8)]))
    got = {x.node: x.component for x in links.components(make([(6, 2), (20, 21)]), first).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 8: 8, 9: 8, 20: 20, 21: 20}
    assert links.components(make([])).count() == 0


def test_copies_go_whatever_the_other_columns_are_called(spark):
    text = "some words that make a text of more than five words"
    d = spark.createDataFrame([(1, text, 1, 2, 3), (2, text, 4, 5, 6), (None, text, 7, 8, 9)], "doc_id long, text string, _gone int, gone int, node int")
    got = minhash.drop_near_duplicates(d)
    assert got.columns == d.columns and sorted(got.select("gone").toPandas()["gone"]) == [2, 8]


def test_rows_that_share_an_id_link_by_each_of_their_texts(spark):
    r = random.Random(8)
    a, b = ([f"w{r.randint(0, 10**6)}" for _ in range(50)] for _ in range(2))
    near = lambda w: " ".join([*w[:49], "other"])
    d = spark.createDataFrame([(1, near(a)), (2, " ".join(a)), (2, " ".join(b)), (3, near(b))], "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(d).collect()}
    assert got == {1: 1, 2: 1, 3: 1}
