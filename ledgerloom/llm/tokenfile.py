"""Token ids as binary files that can be read document by document.

Writing: texts are ordered by doc_id over ranges (a range is a task), encoded,
and each document is compressed on its own with one zstandard dictionary that
all share. The dictionary is trained on the id arrays of a bounded sample
(``sample_docs`` documents, the first ``sample_chars`` characters of each); it
decides how small files are, never what they hold.

A shard (all numbers little-endian):

    8 bytes   MAGIC
    32 bytes  SHA-256 of the dictionary
    8 bytes   bytes an id has (2 or 4)
    frames    one zstandard frame a document, one after another
    index     n doc_ids (int64), n flags (uint8, 0: the doc_id is null),
              n + 1 frame offsets (uint64), n + 1 counts of the ids before (uint64)
    8 bytes   where the index begins
    8 bytes   n
    8 bytes   MAGIC

A task writes its shards under names of its own attempt and returns a row for
each; the rows of the attempts that count are the manifest, which is written
last and makes the files a corpus. What a lost or repeated attempt left behind
is in no manifest. A shard is closed at ``shard_bytes``; its index is what a
writer holds (33 bytes a document).

Reading: ``read_ids`` takes a shard a task and gives each document's place and
checksum; ``fetch`` opens only the shards whose range holds a wanted doc_id and
reads the index and the wanted frames.

Text to ids: texts are split at the safe boundaries of ``tokencount`` and some
more; each distinct piece goes to the library once and its ids are kept (bounded).

Defined results: a null or empty text has the end id alone; rows without doc_id
come first; rows that share a doc_id each have a place, in the order of a hash
of their texts; an empty table has an empty manifest and no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import CACHES, arrow_map, docs_of, shared_dir
from .packing import WordIds
from .tokencount import pieces_of, tokenizer
from .wordhash import BASE_INV, U, mix, powers, prefix_sums, row_blocks, text_bytes

MAGIC = b"LLTOKID1"
HEAD = 48


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*b".,;:!?"]] = True
_SOLID = _LETTER | _MARK


def finer(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``starts`` of pieces and more safe boundaries: between a letter and one of .,;:!?, and on both sides of a single line break between two such characters. The word pattern ends a run at each of these and looks no further."""
    n = len(data)
    cut = np.zeros(n, bool)
    cut[starts] = True
    cut[1:] |= _LETTER[data[:-1]] & _MARK[data[1:]]
    lone = np.flatnonzero(data == 10)
    lone = lone[(lone > 0) & (lone < n - 1)]
    lone = lone[_SOLID[data[lone - 1]] & _SOLID[data[lone + 1]]]
    cut[lone] = cut[lone + 1] = True
    return np.flatnonzero(cut)


class PieceIds(WordIds):
    """Ids of pieces of texts by 64-bit hash; when ``most`` are known all is forgotten and learnt anew."""

    def __init__(self, path: str, most: int = 1_500_000):
        self.path, self.most = path, most
        self.begins = np.zeros(1 << 17, bool)
        for token, i in tokenizer(path).get_vocab().items():
            self.begins[i] = token.startswith("\u0120")  # how a byte-level vocabulary writes a space
        self.forget()

    def learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        """Pieces of a space and letters are encoded many at a time, as one text, and told apart by the ids that begin with a space."""
        encode = tokenizer(self.path).encode_batch_fast
        texts = [w.decode() for w in words]
        plain = np.fromiter((t[0] == " " and t[1:].isalpha() for t in texts), bool, len(texts))
        other = np.flatnonzero(~plain).tolist()
        simple = np.flatnonzero(plain)
        for at in range(0, len(simple), 4_000):
            own = simple[at : at + 4_000]
            ids = np.asarray(encode(["".join([texts[i] for i in own.tolist()])], add_special_tokens=False)[0].ids, "<u4")
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(own) and starts[0] == 0:
                self.add(hashes[own], ids, np.append(starts[1:], len(ids)))
            else:
                other += own.tolist()
        for at in range(0, len(other), 4_000):
            own = other[at : at + 4_000]
            found = [x.ids for x in encode([texts[i] for i in own], add_special_tokens=False)]
            self.add(hashes[own], np.fromiter(chain.from_iterable(found), "<u4"), np.cumsum([len(x) for x in found]))

    def of_rows(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of a block of rows, row offsets)."""
        starts = pieces_of(data, offsets)
        if not len(starts):
            return np.zeros(0, "<u4"), np.zeros(len(offsets), np.int64)
        starts = finer(data, starts)
        ends = np.append(starts[1:], len(data))
        sums = prefix_sums(data)
        hashes = mix((sums[ends] - sums[starts]) * powers(len(data), BASE_INV)[starts] + (ends - starts).astype(U))
        ids, before = self.encode(data, hashes, starts, ends)
        return ids, before[np.searchsorted(starts, offsets)]


_ids: dict[str, PieceIds] = {}
CACHES["tokenfile"] = _ids.clear


def id_rows(column: pa.Array, path: str, end_id: int) -> Iterator[np.ndarray]:
    """The ids of every row of a batch, the end id included."""
    if path not in _ids:
        _ids[path] = PieceIds(path)
    data, offsets = text_bytes(column)
    end = np.array([end_id], "<u4")
    for a, b in row_blocks(offsets):
        ids, bounds = _ids[path].of_rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for at, to in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.concatenate([ids[at:to], end])


def id_width(path: str, end_id: int) -> int:
    return 2 if max(tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4


def sample_arrays(docs: DataFrame, path: str, end_id: int, width: int, sample_docs: int, sample_chars: int) -> list[bytes]:
    """Serialized ids of the sampled documents: those with the smallest hashes of their doc_ids, in a fixed order."""
    hashed = docs.select(F.xxhash64("doc_id").alias("_h"), "text")
    last = hashed.select("_h").orderBy("_h").limit(sample_docs).agg(F.max("_h")).first()[0]
    if last is None:
        return []
    some = hashed.filter(F.col("_h") <= F.lit(last)).select(F.substring("text", 1, sample_chars).alias("text")).limit(sample_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(f"<u{width}").tobytes() for x in id_rows(b.column("text"), path, end_id)], pa.binary())], names=["ids"])

    return sorted(r.ids for r in arrow_map(some, run, "ids binary", "tokenfile").collect())


def train(samples: list[bytes], dictionary_bytes: int) -> bytes:
    """A zstandard dictionary. Where the samples are too few or too short to train one, they are the dictionary themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(dictionary_bytes, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:dictionary_bytes]


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if raw else None


def place(uri: str):
    """(file system, path) of a URI of the shared folder; any that pyarrow can open."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, directory: str) -> str:
    """``directory`` with the scheme that Spark reads it by, so that tasks and Spark mean one place."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(directory)
    uri = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return f"file://{uri.removeprefix('file:')}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


class ShardWriter:
    def __init__(self, directory: str, name: str, digest: bytes, width: int):
        files, root = place(directory)
        self.path = f"{directory}/{name}"
        self.out = files.open_output_stream(f"{root}/{name}")
        self.out.write(MAGIC + digest + width.to_bytes(8, "little"))
        self.docs: list[int | None] = []
        self.offsets, self.before = [0], [0]

    def add(self, doc_id: int | None, frame: bytes, n: int) -> None:
        self.out.write(frame)
        self.docs.append(doc_id)
        self.offsets.append(self.offsets[-1] + len(frame))
        self.before.append(self.before[-1] + n)

    def close(self) -> tuple[str, int, int, int | None, int | None]:
        """(path, documents, ids, smallest and largest doc_id)."""
        named = [d for d in self.docs if d is not None]
        self.out.write(np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array([d is not None for d in self.docs], np.uint8).tobytes())
        self.out.write(np.array(self.offsets, "<u8").tobytes() + np.array(self.before, "<u8").tobytes())
        self.out.write((HEAD + self.offsets[-1]).to_bytes(8, "little") + len(self.docs).to_bytes(8, "little") + MAGIC)
        self.out.close()
        return self.path, len(self.docs), self.before[-1], min(named, default=None), max(named, default=None)


MANIFEST = "task int, shard int, path string, n_docs long, n_ids long, least_doc long, most_doc long"


def write_ids(docs: DataFrame, tokenizer_path: str, directory: str, end_id: int, sample_docs: int = 1_000, sample_chars: int = 8_192, dictionary_bytes: int = 1 << 16, level: int = 3, shard_bytes: int = 256 << 20) -> DataFrame:
    """Write all documents to ``directory`` (a path of the shared folder) in ascending doc_id order; returns the manifest: shard, path, start (ids in the shards before), n_docs, n_ids, least_doc, most_doc."""
    spark, rows = docs.sparkSession, docs_of(docs)
    directory = qualified(spark, directory)
    width = id_width(tokenizer_path, end_id)
    raw = train(sample_arrays(rows, tokenizer_path, end_id, width, sample_docs, sample_chars), dictionary_bytes)
    digest = hashlib.sha256(raw).digest()
    files, root = place(directory)
    files.create_dir(root, recursive=True)
    with files.open_output_stream(f"{root}/dictionary-{digest.hex()}") as out:
        out.write(raw)
    shared = spark.sparkContext.broadcast(raw)  # at most dictionary_bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        known = _dictionary(shared.value)
        compress = zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=True).compress
        done: list[tuple] = []
        shard = None
        for b in batches:
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), id_rows(b.column("text"), tokenizer_path, end_id), strict=True):
                if shard is None:
                    shard = ShardWriter(directory, f"ids-{task:06d}-{len(done):04d}-{attempt}", digest, width)
                shard.add(doc_id, compress(ids.astype(f"<u{width}").tobytes()), len(ids))
                if shard.offsets[-1] >= shard_bytes:
                    done.append((task, len(done), *shard.close()))
                    shard = None
        if shard is not None:
            done.append((task, len(done), *shard.close()))
        if done:
            kinds = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=["task", "shard", "path", "n_docs", "n_ids", "least_doc", "most_doc"])

    order = ["doc_id", F.xxhash64("text")]
    written = arrow_map(rows.repartitionByRange(*order).sortWithinPartitions(*order), run, MANIFEST, "tokenfile").collect()  # a row a shard
    start, listed = 0, []
    for k, r in enumerate(sorted(written, key=lambda r: (r.task, r.shard))):
        listed.append((k, r.path, start, r.n_docs, r.n_ids, r.least_doc, r.most_doc))
        start += r.n_ids
    spark.createDataFrame(listed, "shard long, path string, start long, n_docs long, n_ids long, least_doc long, most_doc long").coalesce(1).write.parquet(f"{directory}/manifest")
    return manifest(spark, directory)


def manifest(spark: SparkSession, directory: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/manifest")


class ShardReader:
    """A shard opened for reading; the dictionary is checked against the hash that the shard keeps."""

    _known: tuple[bytes, object] = (b"", None)

    def __init__(self, uri: str):
        import zstandard

        files, path = place(uri)
        self.file = files.open_input_file(path)
        head = self.file.read_at(HEAD, 0)
        tail = self.file.read_at(24, self.file.size() - 24)
        if head[:8] != MAGIC or tail[16:] != MAGIC:
            raise ValueError(f"{uri} is no complete shard")
        self.width = int.from_bytes(head[40:48], "little")
        at, n = int.from_bytes(tail[:8], "little"), int.from_bytes(tail[8:16], "little")
        index = self.file.read_at(25 * n + 16, at)
        ids, present = np.frombuffer(index, "<i8", n), np.frombuffer(index, np.uint8, n, 8 * n)
        self.docs = [d if p else None for d, p in zip(ids.tolist(), present.tolist(), strict=True)]
        self.offsets = np.frombuffer(index, "<u8", n + 1, 9 * n).astype(np.int64)
        self.before = np.frombuffer(index, "<u8", n + 1, 17 * n + 8).astype(np.int64)
        digest = head[8:40]
        if ShardReader._known[0] != digest:
            with files.open_input_stream(f"{path.rpartition('/')[0]}/dictionary-{digest.hex()}") as f:
                raw = f.read()
            if hashlib.sha256(raw).digest() != digest:
                raise ValueError(f"the dictionary of {uri} has changed")
            ShardReader._known = (digest, _dictionary(raw))
        self.decompress = zstandard.ZstdDecompressor(dict_data=ShardReader._known[1]).decompress

    def ids(self, first: int, last: int) -> Iterator[np.ndarray]:
        """The ids of documents ``first`` to ``last`` - 1 of the shard, as unsigned 32-bit numbers."""
        lo = int(self.offsets[first])
        raw = self.file.read_at(int(self.offsets[last]) - lo, HEAD + lo)
        for a, b in zip((self.offsets[first:last] - lo).tolist(), (self.offsets[first + 1 : last + 1] - lo).tolist(), strict=True):
            yield np.frombuffer(self.decompress(raw[a:b]), f"<u{self.width}").astype("<u4")

    def stretches(self, most: int) -> Iterator[tuple[int, int]]:
        """Runs of documents of about ``most`` bytes of frames."""
        yield from row_blocks(self.offsets, most)


def read_ids(shards: DataFrame, batch_bytes: int = 1 << 20) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and shard of every document of a manifest, from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                shard = ShardReader(r["path"])
                for first, last in shard.stretches(batch_bytes):
                    found = list(shard.ids(first, last))
                    sizes = [len(x) for x in found]
                    if sizes != np.diff(shard.before[first : last + 1]).tolist():
                        raise ValueError(f"{r['path']}: the index does not tell the frames' lengths")
                    n = last - first
                    yield pa.RecordBatch.from_arrays([
                        pa.array(shard.docs[first:last], pa.int64()), pa.array(shard.before[first:last] + r["start"]), pa.array(sizes, pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in found], pa.int64()), pa.array([r["shard"]] * n, pa.int64()),
                    ], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])

    dealt = shards.repartitionByRange(max(1, shards.count()), "shard")
    return arrow_map(dealt, run, "doc_id long, start long, n_tokens long, ids_crc32 long, shard long", "tokenfile")


def fetch(shards: DataFrame, wanted: list[int]) -> DataFrame:
    """doc_id, ids of the ``wanted`` documents (a list that a caller can hold): only shards whose range holds one are opened, and of these only the index and the wanted frames are read."""
    chosen = shards.filter(F.exists(F.array(*[F.lit(d).cast("long") for d in wanted]), lambda d: d.between(F.col("least_doc"), F.col("most_doc")))) if wanted else shards.limit(0)
    asked = set(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                shard = ShardReader(r["path"])
                for k, d in enumerate(shard.docs):
                    if d in asked:
                        yield pa.RecordBatch.from_arrays([pa.array([d], pa.int64()), pa.array([next(shard.ids(k, k + 1)).tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return arrow_map(chosen, run, "doc_id long, ids array<long>", "tokenfile")


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write ``docs`` to a new folder of the shared one and read the files back: doc_id, start, n_tokens, ids_crc32, shard."""
    directory = f"{shared_dir(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    return read_ids(write_ids(docs, tokenizer_path, directory, end_id))
