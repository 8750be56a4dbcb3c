"""The record scanner against one pass over the characters, whatever the splits and chunks."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import export, records


def one_pass(text, most=records.MOST_CHARS):
    """[(line number, text, fields)]: a quote counts at a field's start, and ends its cell where it is not doubled; a cell over lines that is too long is none."""
    out, i, n, line = [], 0, len(text), 1
    while i < n:
        start, first, fields = i, line, []
        while True:
            while i < n and text[i] in " \t":
                i += 1
            begin, value = i, None
            if i < n and text[i] == '"':
                j = i + 1
                while j < n and (text[j] != '"' or text[j : j + 2] == '""'):
                    j += 2 if text[j] == '"' else 1
                if j < n and (j - i - 1 <= most or "\n" not in text[i:j]):
                    e = j + 1
                    while e < n and text[e] not in ",\n":
                        e += 1
                    value = text[i + 1 : j].replace('""', '"') if not text[j + 1 : e].strip(" \t") else text[i:e].strip(" \t")
                    line += text[i:e].count("\n")
                    i = e
            if value is None:
                e = i
                while e < n and text[e] not in ",\n":
                    e += 1
                value, i = text[begin:e].strip(" \t"), e
            fields.append(value or None)
            if i < n and text[i] == ",":
                i += 1
                continue
            break
        out.append((first, text[start:i], fields))
        i, line = i + 1, line + 1
    return out


@pytest.fixture
def split_bytes(spark):
    """Sets how many bytes a split has."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = [spark.conf.get(n, None) for n in names]
    yield lambda n: [spark.conf.set(k, v) for k, v in zip(names, (str(n), "10", "1"), strict=True)]
    for name, value in zip(names, old, strict=True):
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def read(spark, path, **options):
    rows = records.read_records(spark, str(path), **options).withColumn("f", records.split_fields(F.col("raw_line"))).orderBy("line_no").collect()
    return [(r.line_no, r.raw_line, r.f) for r in rows]


@pytest.mark.parametrize("seed", range(8))
def test_any_text_in_any_splits(spark, tmp_path, split_bytes, seed):
    r = random.Random(seed)
    alphabet = ['"', '"', ",", "\n", "a", "bc", " ", '""', "é", '","', '"\n'] if seed % 2 else ['"', ",", "\n", "a", "word ", "x", "y", '12.5" pipe', ',"in, quotes"', "\n"]
    text = "".join(r.choice(alphabet) for _ in range(r.choice([60, 600, 4_000]))).strip("\n") + "\n"
    p = tmp_path / "t.csv"
    p.write_text(text)
    split_bytes(r.choice([40, 200, 3_000]))
    most = r.choice([20, 64, 200, records.MOST_CHARS])
    assert read(spark, p, most_chars=most, chunk_chars=r.choice([30, 100, 1 << 20])) == one_pass(text, most)


def test_a_record_over_many_splits_and_parts_of_a_folder(spark, tmp_path, split_bytes):
    body = 'h1,h2\n1,"' + "one line\n" * 300 + '"\n2,x\n'
    (tmp_path / "parts").mkdir()
    for k, at in enumerate(range(0, len(body), 90)):  # parts end after whole lines here
        (tmp_path / "parts" / f"part-{k:03d}").write_text(body[at : at + 90])
    whole = tmp_path / "whole.csv"
    whole.write_text(body)
    split_bytes(100)
    assert read(spark, whole) == one_pass(body) and len(one_pass(body)) == 3
    lines = body.splitlines(keepends=True)
    for f in (tmp_path / "parts").iterdir():
        f.unlink()
    for k in range(0, len(lines), 7):
        (tmp_path / "parts" / f"part-{k:03d}").write_text("".join(lines[k : k + 7]))
    assert read(spark, tmp_path / "parts") == one_pass(body)
    zipped = tmp_path / "z.csv.gz"
    with gzip.open(zipped, "wt") as f:
        f.write(body)
    assert read(spark, zipped, chunk_chars=200) == one_pass(body)
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    assert read(spark, empty) == [] and records.first_line(spark, str(empty)) == "" and records.first_line(spark, str(tmp_path / "parts")) == "h1,h2"


def test_stray_quotes_cost_no_row(spark, tmp_path):
    """Marks of inches far apart, which a count of all quotes would pair; a quote that opens a cell which never ends."""
    row = lambda i, memo: f"03/04/2025,Acme {i},12-3456789,1.00,check,C-1,Q{i},{memo},,\n"
    memo = {10: '5" pipe', 200: '6" pipe', 250: 'Big "Bob" Henderson'}
    p = tmp_path / "payments.csv"
    p.write_text("Txn Date,Vendor,Vendor Tax ID,Amount,Payment Method,Customer,Txn ID,Memo,Account,Transaction Type\n" + "".join(row(i, memo.get(i, "m")) for i in range(300)))
    got = {r.source_txn_id: r for r in export.read_payments(spark, str(p), None).collect()}
    assert len(got) == 300 and all(r.n_fields == r.n_headers for r in got.values())
    assert {k: got[f"Q{k}"].memo for k in memo} == memo and got["Q299"].line_no == 301
    p.write_text("Txn Date,Vendor,Memo\n" + "03/04/2025,A,m\n" * 20_000 + '03/04/2025,A,"never closed\n' + "03/04/2025,A,m\n" * 20_000)
    last = export.read_payments(spark, str(p), None)
    assert last.count() == 40_001 and last.filter("n_fields <> 3").isEmpty() and last.filter("line_no = 20002").first().memo == '"never closed'


def test_long_cells(spark, tmp_path):
    """60,000 characters in quotes are a cell like others; a cell of more than 64 KiB makes its row ragged and nothing more."""
    p = tmp_path / "payments.csv"
    long, longer = ('say ""x"" ' * 6_000)[:60_000], "y" * 70_000
    p.write_text(f'Date,Vendor,Memo\n1,A,"{long}"\n2,B,"{longer}"\n3,C,{longer}\n4,D,m\n')
    got = {r.payment_date: (r.n_fields, len(r.memo)) for r in export.read_payments(spark, str(p), None).select("payment_date", "n_fields", "memo").collect()}
    assert got == {"1": (3, len(long.replace('""', '"'))), "2": (-1, 70_000), "3": (-1, 70_000), "4": (3, 1)}


def test_what_is_written_is_read(spark, tmp_path):
    values = ["plain", 'a "b" c', '"x', 'y"', "two\nlines", "a,b", " lead", "tail ", "", '""', '"', "é日本", '",\n"']
    rows = spark.createDataFrame([(f"{i:04d}", v) for i, v in enumerate(values * 40)], "key string, v string")
    records.write_lines(rows.select("key", F.concat_ws(",", "key", records.cell(F.col("v")), F.lit("end")).alias("value")), "k,v,e", str(tmp_path / "out"))
    got = read(spark, tmp_path / "out")
    assert [f for _, _, f in got[1:]] == [[f"{i:04d}", v or None, "end"] for i, v in enumerate(values * 40)]
