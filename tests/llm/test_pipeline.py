import random
from collections import defaultdict

import pytest
from test_minhash import brute
from test_simple_operators import brute_lines
from test_toxicity import UNSEEN, corpus

import corpus_pipeline


LINE = "this very line is repeated in six of the documents here"


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, texts):
    """Planted cases in a small corpus of its own: toxic documents, repeated lines, near copies, a benchmark passage, nulls."""
    r = random.Random(4)
    rows = [(i, t, "en", "a", len(t)) for i, t, _ in corpus(300)]
    labels = [(i, 1, y) for i, _, y in corpus(300)]
    clean = [t for _, t, y in corpus(300) if not y]
    passage = " ".join(f"bench{r.randint(0, 10**6)}" for _ in range(30))
    rows += [(400, clean[3] + " tail", "en", "a", 9), (401, clean[5], "en", "a", 9), (402, clean[6][:200] + " " + passage + " " + clean[7], "en", "a", 9)]
    rows += [(410 + i, f"{clean[20 + i]}\n{LINE}\nend", "en", "b", 9) for i in range(6)]
    rows += [(430 + i, t, "en", "b", 9) for i, t in enumerate(UNSEEN[1:])]
    rows += [(500, None, None, None, None), (501, "", "en", "c", 0), (None, "no id " * 20, "en", "c", 5)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        from ledgerloom.llm.common import keep

        docs = keep(stage(spark, docs, sf_dir), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        tables.append(docs)
    ids = [{r.doc_id: r.text for r in t.collect()} for t in tables]
    toxic = {i for i, _, y in corpus(300) if y}
    assert ids[0].keys() - ids[1].keys() <= toxic and len(toxic - (ids[0].keys() - ids[1].keys())) <= 2
    want = brute_lines([ids[1][i] for i in ids[1]], [i if i is not None else -1 for i in ids[1]], 5)
    assert {(-1 if i is None else i): t for i, t in ids[2].items()} == {i: v[0] for i, v in want.items()}
    assert sum(f"\n{LINE}\n" in t for t in ids[2].values()) == 1
    real = {i: t for i, t in ids[2].items() if i is not None}
    group = brute(list(real), list(real.values()), 5)
    assert ids[3].keys() - {None} == {i for i, (_, c) in group.items() if c == i}
    assert 400 not in ids[3] and 401 not in ids[3]
    assert ids[3].keys() - ids[4].keys() == {402}
    assert None in ids[4] and ids[4][500] == ids[4][501] == ""
    bins = defaultdict(int)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    for r in rows:
        bins[r.sequence_id] += r.length
    assert {r.doc_id for r in rows} == set(ids[4]) and max(bins.values()) <= 4096


def test_run_applies_all_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.filter("doc_id = 402").count() == 0 and out.filter("doc_id = 501").count() == 1
