"""Records of delimited text in parallel: a quote-aware scanner over the splits of a file.

Whether a line break ends a record depends on all text before it, yet a file is
read in splits. The scanner rests on these facts:

* A quote counts only at a field's start. A quoted cell ends at its first quote
  that is not doubled; what then stands before the next delimiter makes the
  field literal, quotes included (as does any quote inside an unquoted field).
* So a line is one of few kinds, told by patterns that never back up: does it
  leave a cell open if it begins outside (``opens``), or inside one (``reopens``),
  and has it a quote that closes a cell begun before (``closes``)?
* A cell over several lines of more than ``most_chars`` characters is no cell:
  the quote that seems to open it stays literal and its line ends its record. The
  damage of a stray quote is its own row.

Pass 1 scans each chunk (a split, or every ``chunk_chars`` characters of a longer
one, as of a gzipped file) for both ways to enter it and returns one row: lines,
the characters to its first closing quote, and for each way the cell left open
at its end, of which there is at most one. Composing these rows in file order
tells how each chunk is entered and whether its open cell finds its end in time.
Pass 2 cuts each chunk's records. Only the pieces of a record that crosses a
chunk's end (two a chunk at most) are gathered, from a reading of such chunks.

The rows of pass 1 come to the driver: ten numbers a chunk. A path may be a
folder: its files, in the order of their names, are the parts of one text.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_CHARS = 64 * 1024
MOST_COLUMNS = 64
CHUNK_CHARS = 64 << 20

_CLOSED = r'[^"]*+(?:""[^"]*+)*+'  # inside a cell, up to a quote that is not doubled
_FIELD = rf'[ \t]*+(?:"{_CLOSED}"[^,]*+|[^", \t][^,]*+)?+'
_OPEN = rf'(?:{_FIELD},)*+[ \t]*+"{_CLOSED}$'


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (where the line's split begins), value, chars, and what the line does to cells."""
    v = F.col("value")
    quoted = F.contains(v, F.lit('"'))
    raw = spark.read.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), "value")
    marked = raw.select(
        "file", "block", "value", F.char_length(v).alias("chars"),
        F.when(quoted, v.rlike(f"^{_OPEN}")).otherwise(False).alias("opens"),
        F.when(quoted, v.rlike(f'^{_CLOSED}"[^,]*+,{_OPEN}')).otherwise(False).alias("reopens"),
        F.when(quoted, ~v.rlike(f"^{_CLOSED}$")).otherwise(False).alias("closes"),
        F.when(quoted, F.char_length(F.regexp_extract(v, f"^{_CLOSED}", 0))).otherwise(0).alias("lead"),
    )
    return marked.withColumn("tail", F.when(F.col("opens") | F.col("reopens"), F.char_length(F.regexp_extract(v, f'"({_CLOSED})$', 1))).otherwise(0))  # asked of lines that leave a cell open


_MARKS = ("chars", "opens", "reopens", "closes", "lead", "tail")


class Chunk:
    """The lines of a chunk; ``before`` counts the characters up to each line, a line break being one."""

    def __init__(self, rows: pa.Table, most_chars: int):
        self.most_chars = most_chars
        self.chars, self.opens, self.reopens, self.closes, self.lead, self.tail = (rows.column(c).to_numpy().astype(np.int64 if c in ("chars", "lead", "tail") else bool) for c in _MARKS)
        self.before = np.concatenate([[0], np.cumsum(self.chars + 1)])
        self.closers, self.openers = np.flatnonzero(self.closes), np.flatnonzero(self.opens)

    def first_close(self) -> int:
        """Characters before the first quote that would close a cell, -1 if there is none."""
        return int(self.before[self.closers[0]] + self.lead[self.closers[0]]) if len(self.closers) else -1

    def left_open(self, line: int) -> int:
        """Characters of the open cell of ``line`` up to the chunk's end."""
        return int(self.before[-1] - self._begun(line))

    def _begun(self, line: int) -> int:
        return int(self.before[line + 1] - 1 - self.tail[line])

    def _follow(self, line: int) -> tuple[int, bool]:
        """From a line that leaves a cell open: (the last line of its record as far as is seen, whether that leaves a cell open that may yet close)."""
        while True:
            k = int(np.searchsorted(self.closers, line + 1))
            if k == len(self.closers):
                return line, self.left_open(line) <= self.most_chars
            close = int(self.closers[k])
            if self.before[close] + self.lead[close] - self._begun(line) > self.most_chars:
                return line, False
            if not self.reopens[close]:
                return close, False
            line = close

    def records(self, inside: bool) -> tuple[list[tuple[int, int]], int, int]:
        """(first and last line of each record of several lines, the line that leaves a cell open at the end, the first line of that one's record).

        Line -1 stands for a line before the chunk, or for none. Entered inside a
        cell, a chunk without a closing quote is all of one record.
        """
        out: list[tuple[int, int]] = []
        at = 0
        if inside:
            if not len(self.closers):
                return out, -1, -1
            last, pending = (int(self.closers[0]), False) if not self.reopens[self.closers[0]] else self._follow(int(self.closers[0]))
            out.append((-1, last))
            if pending:
                return out, last, -1
            at = last + 1
        while (k := int(np.searchsorted(self.openers, at))) < len(self.openers):
            first = int(self.openers[k])
            last, pending = self._follow(first)
            if last > first:
                out.append((first, last))
            if pending:
                return out, last, first
            at = last + 1
        return out, -1, -1


def _chunks(batches: Iterator[pa.RecordBatch], chunk_chars: int) -> Iterator[tuple[str, int, int, pa.Table]]:
    """(file, block, number, rows) of each chunk of a task's splits."""
    held: list[pa.RecordBatch] = []
    key, total = None, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        files, blocks = b.column("file").dictionary_encode(), b.column("block").to_numpy()
        codes = files.indices.to_numpy()
        edges = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for a, z in zip([0, *edges.tolist()], [*edges.tolist(), n], strict=True):
            split = (files.dictionary[int(codes[a])].as_py(), int(blocks[a]))
            if key is None or split != key[:2]:
                total = 0
            ends = total + np.cumsum(b.column("chars").to_numpy()[a:z] + 1)
            numbers = np.concatenate([[total], ends[:-1]]) // chunk_chars  # by where a line begins
            total = int(ends[-1])
            cuts = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), z - a]
            for c, d in zip(cuts[:-1], cuts[1:], strict=True):
                own = (*split, int(numbers[c]))
                if key is not None and own != key:
                    yield *key, pa.Table.from_batches(held)
                    held = []
                key = own
                held.append(b.slice(a + c, d - c))
    if key is not None:
        yield *key, pa.Table.from_batches(held)


FACTS = "file string, block long, number long, n_lines long, n_chars long, first_close long, open_out long, begun_out long, left_out long, open_in long, begun_in long, left_in long"


def _facts(lines: DataFrame, most_chars: int, chunk_chars: int) -> DataFrame:
    """Pass 1: for each chunk and way to enter it, the line that leaves a cell open at the end, where its record began, and the characters of the cell so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for *key, rows in _chunks(batches, chunk_chars):
            c = Chunk(rows, most_chars)
            ways = []
            for inside in (False, True):
                _, line, begun = c.records(inside)
                ways += [line, begun, c.left_open(line) if line >= 0 else 0]
            out.append((*key, rows.num_rows, int(c.before[-1]), c.first_close(), *ways))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=[x.split()[0] for x in FACTS.split(", ")])

    return lines.select("file", "block", *_MARKS).mapInArrow(run, FACTS)


#: How pass 2 takes a chunk: the number of its first line, the number of the line where the record that it is entered in began (0: it is entered outside), and whether the cell that it leaves open is one.
Entry = tuple[int, int, bool]


def compose(facts: list, most_chars: int) -> dict[tuple[str, int, int], Entry]:
    """The entries of all chunks, in file order, from the rows of pass 1."""
    facts = sorted(facts, key=lambda r: (r.file, r.block, r.number))
    never = 1 << 62
    ends = [never] * (len(facts) + 1)  # characters from each chunk's begin to the next quote that closes a cell
    for k in range(len(facts) - 1, -1, -1):
        r = facts[k]
        ends[k] = r.first_close if r.first_close >= 0 else min(r.n_chars + ends[k + 1], never)
    out: dict[tuple[str, int, int], Entry] = {}
    line, record = 1, 0
    for k, r in enumerate(facts):
        key = (r.file, r.block, r.number)
        if record and r.first_close < 0:  # all of it stands inside one cell, which ends in time
            out[key] = (line, record, True)
        else:
            at, begun, left = (r.open_in, r.begun_in, r.left_in) if record else (r.open_out, r.begun_out, r.left_out)
            keeps = at >= 0 and left + ends[k + 1] <= most_chars
            out[key] = (line, record, keeps)
            record = 0 if not keeps else record if begun < 0 else line + begun
        line += r.n_lines
    return out


PIECES = "line_no long, part long, raw_line string"


def _pieces(lines: DataFrame, entries: dict[tuple[str, int, int], Entry], crossing: bool, most_chars: int, chunk_chars: int) -> DataFrame:
    """Pass 2: the records that stand in one chunk, or (``crossing``) the pieces of those that do not: line_no of the record, part (the piece's first line) and text."""
    sent = lines.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        batch = lambda numbers, parts, texts: pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(parts, pa.int64()), texts], names=["line_no", "part", "raw_line"])
        for *key, rows in _chunks(batches, chunk_chars):
            first, record, keeps = known[tuple(key)]
            n, values = rows.num_rows, rows.column("value")
            several, at, begun = Chunk(rows, most_chars).records(record > 0)
            whole = record > 0 and at < 0 and not several  # no closing quote in it
            if whole or keeps and begun < 0:
                edge = [(-1, n)]
            else:
                edge = [(-1, several[0][1])] if several and several[0][0] < 0 else []
                edge += [(begun, n)] if keeps else []
            inner = [(a, z) for a, z in several if a >= 0 and not (keeps and a == begun)]
            text = lambda a, z, values=values: "\n".join(values.slice(max(a, 0), min(z, n - 1) - max(a, 0) + 1).to_pylist())  # noqa: B023, E731
            if crossing:
                if edge:
                    yield batch([record if a < 0 else first + a for a, _ in edge], [first + max(a, 0) for a, _ in edge], pa.array([text(a, z) for a, z in edge], pa.string()))
                continue
            single = np.ones(n, bool)
            for a, z in edge + inner:
                single[max(a, 0) : z + 1] = False
            numbers = first + np.flatnonzero(single)
            for b in pa.Table.from_arrays([values.filter(pa.array(single))], names=["v"]).to_batches(max_chunksize=10_000):
                own, numbers = numbers[: b.num_rows], numbers[b.num_rows :]
                yield batch(own, own, b.column("v"))
            for k in range(0, len(inner), 1_000):
                part = inner[k : k + 1_000]
                starts = [first + a for a, _ in part]
                yield batch(starts, starts, pa.array([text(a, z) for a, z in part], pa.string()))

    return lines.select("file", "block", "value", *_MARKS).mapInArrow(run, PIECES)


def read_records(spark: SparkSession, path: str, most_chars: int = MOST_CHARS, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """(line_no, raw_line) of every record of a text file or a folder of its parts: the number of its first line, from 1, and its text with line breaks as \\n."""
    lines = _lines(spark, path)
    entries = compose(_facts(lines, most_chars, chunk_chars).collect(), most_chars)
    out = _pieces(lines, entries, False, most_chars, chunk_chars).select("line_no", "raw_line")
    crossed = [(f, b) for (f, b, _), (_, record, keeps) in entries.items() if record or keeps]
    if crossed:
        blocks = spark.createDataFrame(sorted(set(crossed)), "file string, block long")
        pieces = _pieces(lines.join(F.broadcast(blocks), ["file", "block"], "left_semi"), entries, True, most_chars, chunk_chars)  # at most as many rows as entries
        joined = pieces.groupBy("line_no").agg(F.array_sort(F.collect_list(F.struct("part", "raw_line"))).alias("p"))
        out = out.unionByName(joined.select("line_no", F.array_join("p.raw_line", "\n").alias("raw_line")))
    return out


def first_line(spark: SparkSession, path: str) -> str:
    """The first line of a file or of a folder's first part, empty if there is none."""
    file = spark.read.format("binaryFile").load(path).agg(F.min("path")).first()[0]
    row = spark.read.text(file).first() if file else None
    return row.value if row else ""


def split_fields(raw: Column) -> Column:
    """The fields of a record as text: a closed quoted cell without its quotes, its doubled quotes single; anything else as it stands, trimmed. Empty fields are null."""
    plain = F.split(raw, ",", -1)
    found = F.regexp_extract_all(F.concat(F.lit(","), raw), F.lit(rf',[ \t]*+("{_CLOSED}"[^,]*+|[^,]*+)'), F.lit(1))
    cells = F.when(F.contains(raw, F.lit('"')), found).otherwise(plain)
    quoted = rf'^"({_CLOSED})"[ \t]*+$'
    value = lambda c: F.when(c.rlike(quoted), F.replace(F.regexp_extract(c, quoted, 1), F.lit('""'), F.lit('"'))).otherwise(F.regexp_replace(c, r"^[ \t\r]++|[ \t\r]++$", ""))
    return F.transform(cells, lambda c: F.nullif(F.when(F.contains(c, F.lit('"')), value(c)).otherwise(F.trim(c)), F.lit("")))


def cell(c: Column) -> Column:
    """A field as it is written: in quotes, its own doubled, where it holds a delimiter, a quote or a line break, or begins or ends with white space."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike(r'[",\r\n]|^\s|\s$'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def write_lines(rows: DataFrame, header: str, path: str, **options) -> None:
    """``rows`` (key, value) as one text in parts, in the order of ``key`` (text), after a header line; each part is a task's."""
    first = rows.sparkSession.createDataFrame([("", header)], "key string, value string")
    first.unionByName(rows.select(F.col("key").cast("string").alias("key"), "value")).repartitionByRange("key").sortWithinPartitions("key").select("value").write.options(**options).text(path)
