import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import chat, decontam, fingerprint, linededup, packing, tokencount

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def test_token_counts_equal_the_library_whatever_is_kept(docs, texts):
    t = Tokenizer.from_file(BYTE)
    want = {3 * i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in enumerate(texts)}
    for known in (10**6, 50):
        got = {r.doc_id: r for r in tokencount.token_counts(docs, BYTE, limit=100, batch_bytes=500, pieces_known=known).collect()}
        assert {k: (r.n_bytes, r.n_tokens) for k, r in got.items()} == want
        assert all(r.over_limit == (r.n_tokens > 100) for r in got.values())


def test_pieces_keep_counts_in_odd_texts():
    import random

    import pyarrow as pa

    t, r = Tokenizer.from_file(BYTE), random.Random(6)
    parts = ["a", "é", "ß.", "don't", " ", "  ", "\n", "\t ", "\u00a0", "\u2003", "\u3000", "\x85", "日本", "12", "3,4", "<|endoftext|>", "!!", "\U0001f600", "Ā", "\x1f", "\x7f"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 40))) for _ in range(3000)]
    _, n = tokencount.count_batch(pa.array(texts), BYTE, 1 << 12, 10**5)
    assert n.tolist() == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_packing_is_gapless_whole_and_near_the_lower_bound(docs, texts):
    t, cap = Tokenizer.from_file(WORD), 256
    rows = packing.pack(docs, WORD, capacity=cap, rank_group=20).collect()
    ids = {3 * i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in enumerate(texts)}
    bins = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    assert by_doc.keys() == ids.keys()
    for d, rs in by_doc.items():
        rs.sort(key=lambda r: r.piece)
        assert [r.piece for r in rs] == list(range(len(rs)))
        for r in rs:
            part = ids[d][r.start : r.start + r.length]
            assert len(part) == r.length and r.start == r.piece * cap
            assert zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r.ids_crc32
        assert sum(r.length for r in rs) == len(ids[d])
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= cap
    assert len(bins) <= -(-sum(map(len, ids.values())) // cap) + 2


def test_fullest_combination_is_optimal_on_small_cases():
    from itertools import product

    for lengths in ({7: 2, 5: 1, 3: 4}, {9: 1, 4: 2}, {10: 3}, {6: 1, 5: 5, 2: 1}):
        cap = 12
        best = max(s for n in product(*[range(c + 1) for c in lengths.values()]) if n[0] and (s := sum(a * b for a, b in zip(n, lengths, strict=True))) <= cap)
        found = packing.fullest(dict(lengths), cap)
        assert sum(a * b for a, b in found.items()) == best and all(b <= lengths[a] for a, b in found.items())


def brute_lines(texts, ids, least_docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(lower)
    holds = defaultdict(set)
    for i, t in zip(ids, texts, strict=True):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holds[key(x)].add(i)
    bad = {k: max(v) for k, v in holds.items() if len(v) >= least_docs}
    return {i: ["\n".join(x for x in (t or "").split("\n") if bad.get(key(x), i) == i), len((t or "").split("\n"))] for i, t in zip(ids, texts, strict=True)}


@pytest.mark.parametrize("way", ["broadcast", "join"])
def test_line_dedup_equals_brute_force(docs, texts, way):
    got = linededup.dedup_lines(docs, broadcast_keys=10**6 if way == "broadcast" else -1).collect()
    want = brute_lines(texts, [3 * i for i in range(len(texts))], 5)
    assert {r.doc_id: [r.text, r.n_lines] for r in got} == want
    assert sum(r.n_dropped for r in got) > 10


def test_fingerprints(docs, texts):
    rows = {r.doc_id: r for r in fingerprint.fingerprints(docs, k=64).select("*", fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch"), 64).alias("near"), fingerprint.resemblance(F.col("sketch"), F.col("next_sketch"), 64).alias("next"), fingerprint.distinct_count(F.col("sketch"), 64).alias("n")).collect()}
    assert len(rows) == len(texts)
    shingles = lambda x: (lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())(re.findall(r"[^\x20\x09-\x0D]+", x))
    off = []
    for i, t in enumerate(texts):
        a, b = t or "", texts[(i + 1) % len(texts)] or ""
        n = len(a)
        e = a[: n - n // 4] + b[: n // 4]
        r = rows[3 * i]
        assert r.n_chars == n and r.edited == e
        x, y, z = shingles(a), shingles(e), shingles(b)
        for got, other in ((r.near, y), (r.next, z)):
            true = len(x & other) / len(x | other) if x | other else 1.0
            off.append(abs(got - true))
            assert off[-1] <= (0.3 if len(x | other) > 64 else 1e-9)
        if len(x) < 64:
            assert r.n == len(x)
        else:
            assert abs(r.n / len(x) - 1) < 0.6
    assert sum(off) / len(off) < 0.03
    assert len({tuple(rows[3 * i].sketch) for i, t in enumerate(texts) if t == texts[-2]}) == 1


def test_fingerprint_neighbours_with_repeated_null_and_far_ids(spark):
    rows = [(5, "b"), (5, "a"), (None, "n"), (-(2**63) + 5, "low"), (2**63 - 1, "high"), *[(100 + i, f"t{i}") for i in range(300)]]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = [(r.doc_id, r.text, r.next.text) for r in fingerprint.with_next(d, rows_a_group=7).collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert sorted(got, key=str) == sorted([(a[0], a[1], b[1]) for a, b in zip(order, [*order[1:], order[0]], strict=True)], key=str)


def test_decontamination_finds_substituted_passages_and_no_others(spark):
    import random

    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(1, 6))) for _ in range(3000)]
    prose = lambda k: r.choices(vocabulary, k=k)
    items = [prose(k) for k in (15, 20, 40, 59)]
    docs, leaked = [], set()
    for i in range(60):
        w = prose(r.randint(30, 400))
        if i % 3 == 0:
            own = list(items[i % 4])
            for j in range(0, len(own), 9):
                own[j + 4 if j + 4 < len(own) else j] = "zzz"
            own[0] = own[0].upper() + ","
            w = w[:20] + own + w[20:]
            leaked.add((i, i % 4))
        docs.append((i, " ".join(w)))
    docs += [(60, None), (61, ""), (62, "short")]
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(9, None), (10, ""), (11, "too short"), (12, "zzz")], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for tokens in (10**6, 10):
        got = {(x.doc_id, x.item_id) for x in decontam.contamination(d, b, block_tokens=tokens).collect()}
        assert got == leaked
    assert {x.doc_id for x in decontam.decontaminate(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in leaked}


def brute_chat(rows, part):
    talks = defaultdict(list)
    for c, turn, role, text in rows:
        talks[c].append((turn or 0, role or "unknown", text or ""))
    out = Counter()
    for c, said in talks.items():
        said.sort()
        stretches, cuts = defaultdict(int), []
        for t, _, _ in said:
            k = t // part
            cuts.append((k, stretches[k] // part))
            stretches[k] += 1
        for p in {r for _, r, _ in said} - {"system"}:
            whole = ""
            for k, cut in enumerate(sorted(set(cuts))):
                own, start, spans, n = [x for x, y in zip(said, cuts, strict=True) if y == cut], len(whole), [], 0
                for _, role, text in own:
                    whole += "<|assistant|>\n" if role == p else "<|system|>\n" if role == "system" else f"<|user name={role}|>\n"
                    if role == p:
                        spans.append(f"{len(whole)}-{len(whole) + len(text)}")
                        n += len(text)
                    whole += text + "\n<|end|>\n"
                out[c, p, k, len(own), start, whole[start:], ",".join(spans), n] += 1
    return out


def test_chat_perspectives(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hé"), (1, 2, "bob", None), (1, 2, "ann", "tie"), (1, 3, None, "x"), (2, 0, "system", "alone"), (3, None, "a", "q"), (3, 9, "b", "r"), (3, 9, "b", "r"), (None, 0, "a", "nul")]
    d = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, part string")
    got = Counter(tuple(r) for r in chat.perspectives(d, turns_a_part=4).collect())
    assert got == brute_chat(rows, 4)
    for r in got:
        assert sum(int(b) - int(a) for a, b in (x.split("-") for x in r[6].split(",") if x)) == r[7]


def test_a_long_conversation_with_equal_and_null_turn_numbers_is_cut_and_whole(spark):
    rows = [(1, (i % 3) if i % 2 else None, f"r{i % 5}", f"text {i} é" * (i % 4)) for i in range(2_000)] + [(1, 5_000 + i, "late" if i % 2 else "system", "x") for i in range(1_000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    got = Counter(tuple(r) for r in chat.perspectives(d, turns_a_part=100).collect())
    assert got == brute_chat(rows, 100)
    for p in {r[1] for r in got}:
        parts = sorted((r for r in got if r[1] == p), key=lambda r: r[2])
        assert max(r[3] for r in parts) <= 100 and len(parts) >= 30
        whole = "".join(r[5] for r in parts)
        said = ["" if y is None else y for _, _, role, y in rows if role == p]
        assert sorted(whole[int(a) : int(b)] for r in parts for a, b in (x.split("-") for x in r[6].split(",") if x)) == sorted(said)


def brute_alignments(docs, items, stretch=20, agree=0.8, least=5):
    """(document, item) to the best diagonal's (document start, item start, aligned, equal), all diagonals tried."""
    tokens = lambda x: re.findall(r"(?:[0-9A-Za-z]|[^\x00-\x7f])+", (x or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    out = {}
    for i, d in docs:
        d = tokens(d)
        for j, t in items:
            t = tokens(t)
            need = min(stretch, len(t))
            if len(t) < least:
                continue
            for diagonal in range(-len(t) + 1, len(d)):
                a, b = max(0, -diagonal), min(len(t), len(d) - diagonal)
                if b - a < need:
                    continue
                same = [t[k] == d[k + diagonal] for k in range(a, b)]
                if any(5 * sum(same[k : k + need]) >= 4 * need for k in range(len(same) - need + 1)):
                    now = (a + diagonal, a, b - a, sum(same))
                    if (i, j) not in out or (now[3], -now[0]) > (out[i, j][3], -out[i, j][0]):
                        out[i, j] = now
    return out


def test_decontamination_equals_exact_alignment_on_all_diagonals(spark):
    import random

    r = random.Random(13)
    vocabulary = [f"w{i}" for i in range(60)] + ["ÉCOLE", "naïve", "日本"]
    prose = lambda k: r.choices(vocabulary, k=k)
    items = [(k, prose(n)) for k, n in enumerate([5, 6, 7, 9, 10, 12, 14, 15, 16, 18, 19, 20, 25, 40, 80] * 2)]
    docs = []
    for i in range(150):
        w = prose(r.randint(0, 120))
        for _ in range(r.randint(0, 2)):
            own = list(r.choice(items)[1])
            every = r.choice([0, 4, 5, 6, 9])
            for k in range(r.randint(0, 4), len(own), every) if every else ():
                own[k] = "zzz"
            lo = r.choice([0, 0, len(own) // 4])
            at = r.randint(0, len(w))
            w = w[:at] + own[lo:] + w[at:]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w)))
    long = prose(30_000)
    docs += [(500, " ".join(long[:15_000] + items[14][1] + long[15_000:])), (501, None), (502, "")]
    docs.append((503, docs[3][1]))
    texts = [(k, " ".join(x)) for k, x in items] + [(100, "w1 w2 w3"), (101, None), (102, "")]
    want = brute_alignments(docs, texts)
    ties = [k for k in want if k[0] < 500]
    assert len(ties) > 40 and (500, 14) in want
    d = spark.createDataFrame([(*x, 1, "n") for x in docs] + [(3, docs[3][1], 1, "n")], "doc_id long, text string, item_id int, n_equal string").repartition(4)
    b = spark.createDataFrame(texts, "item_id long, text string")
    rows = decontam.contamination(d, b).collect()
    got = {(x.doc_id, x.item_id): (x.doc_start, x.item_start, x.n_aligned, x.n_equal) for x in rows}
    assert len(rows) == len(got) and got.keys() == want.keys()
    assert {k: v[3] for k, v in got.items()} == {k: v[3] for k, v in want.items()}  # as many equal tokens as the best of all diagonals
    assert sum(got[k] == want[k] for k in want) >= 0.98 * len(want)


def test_masks_lose_no_way_to_substitute_a_fifth():
    from itertools import combinations

    for n, wrong in ((15, 3), (16, 3), (17, 3), (18, 3), (19, 3), (20, 4)):
        for gone in combinations(range(n), wrong):
            holes = sum(1 << k for k in gone)
            assert any(not (int(m[::-1], 2) << at) & holes for m in decontam.MASKS for at in range(n - len(m) + 1))
    for n in range(5, 15):
        m = decontam.solid_mask(n, 0.8)
        for gone in combinations(range(n), n // 5):
            assert any(not set(range(at, at + len(m))) & set(gone) for at in range(n - len(m) + 1))


def test_columns_with_clashing_names_pass(spark):
    line = "a line of more than forty characters that repeats"
    d = spark.createDataFrame([(i, f"{line}\nx{i}", i, i, i) for i in range(6)] + [(None, None, 9, 9, 9)], "doc_id long, text string, _leaked int, n_lines int, gone int")
    got = linededup.dedup_lines(d)
    assert got.columns == ["doc_id", "text", "_leaked", "gone", "n_lines", "n_dropped"] and {r.n_lines for r in got.collect()} == {1, 2}
    b = spark.createDataFrame([(1, line)], "item_id long, text string")
    assert decontam.decontaminate(d, b).columns == d.columns and decontam.decontaminate(d, b).count() == 1


def test_empty_tables(spark, no_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert tokencount.token_counts(no_docs, BYTE).count() == 0
    assert packing.pack(no_docs, WORD).count() == 0
    assert linededup.dedup_lines(no_docs).count() == 0
    assert fingerprint.fingerprints(no_docs).count() == 0
    assert decontam.contamination(no_docs, items).count() == 0
    assert chat.perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_repeated_rows(spark):
    d = spark.createDataFrame([(1, "same words here " * 8)] * 3 + [(i, "same words here " * 8) for i in range(2, 6)], "doc_id long, text string")
    rows = packing.pack(d, WORD, capacity=16).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    got = linededup.dedup_lines(d, min_docs=5).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in got) == [(1, 1)] * 3 + [(2, 1), (3, 1), (4, 1), (5, 0)]
    assert hashlib.sha256(b"").hexdigest() in {hashlib.sha256(r.text.encode()).hexdigest() for r in got}
