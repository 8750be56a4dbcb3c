"""Token counts: batch encoding in an Arrow function that returns lengths only.

Every text, long or short, is split at safe boundaries: before a single space
between two characters that are no white space. The encoder's word pattern never
matches across such a point (each of its runs ends before the space, which joins
the run after it), and no special string of the vocabulary holds a space, so a
text's count is the sum over its pieces. Pieces are told by a 64-bit hash; each
distinct new piece goes to the library once, in encoder batches of about equal
bytes, and its length is kept (a bounded number of 12-byte entries).

Around the space only ASCII characters and two-byte characters from U+00C0 on
are taken for no white space; where others stand, the text is not split, which
costs nothing but a longer piece.

Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows
each give a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CACHES, arrow_map, docs_of
from .wordhash import BASE_INV, SPACE, U, mix, powers, prefix_sums, row_blocks, text_bytes

_SOLID = ~SPACE
_SOLID[128:] = False
_SOLID[:32] = False
_SOLID[127] = False
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces of a block of rows, row starts included (an empty row has none)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    solid, lead = _SOLID[data], _LEAD[data]
    before = np.zeros(n, bool)  # the character that ends before this byte is no white space
    before[1:] = solid[:-1]
    before[2:] |= lead[:-2]
    after = np.zeros(n, bool)
    after[:-1] = solid[1:] | lead[1:]
    cut = (data == 32) & before & after
    cut[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(cut)


class Lengths:
    """Token counts of pieces by hash; when ``most`` are known all is forgotten and learnt anew."""

    def __init__(self, path: str, most: int = 1_000_000):
        self.path, self.most = path, most
        self.keys, self.counts = np.zeros(0, U), np.zeros(0, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The count of each piece, -1 if it is new."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.counts[at], -1)

    def learn(self, hashes: np.ndarray, texts: list[bytes], batch_bytes: int) -> None:
        encode, counts, held, size = tokenizer(self.path).encode_batch_fast, [], [], 0
        for t in texts:
            held.append(t.decode("utf-8"))
            size += len(t)
            if size >= batch_bytes:
                counts += [len(x) for x in encode(held, add_special_tokens=False)]
                held, size = [], 0
        if held:
            counts += [len(x) for x in encode(held, add_special_tokens=False)]
        at = np.searchsorted(self.keys, hashes)  # hashes come sorted
        self.keys, self.counts = np.insert(self.keys, at, hashes), np.insert(self.counts, at, counts)

    def of(self, data: np.ndarray, offsets: np.ndarray, batch_bytes: int) -> np.ndarray:
        """Tokens of every row of a block."""
        starts = pieces_of(data, offsets)
        if not len(starts):
            return np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        sums = prefix_sums(data)
        hashes = mix((sums[ends] - sums[starts]) * powers(len(data), BASE_INV)[starts] + (ends - starts).astype(U))
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) + len(distinct) > self.most:
            self.keys, self.counts = self.keys[:0], self.counts[:0]
        found = self.find(distinct)
        new = np.flatnonzero(found < 0)
        if len(new):
            raw = data.tobytes()
            self.learn(distinct[new], [raw[starts[i] : ends[i]] for i in first[new].tolist()], batch_bytes)
            found = self.find(distinct)
        total = np.concatenate([[0], np.cumsum(found[inverse])])
        return np.diff(total[np.searchsorted(starts, offsets)])


_lengths: dict[str, Lengths] = {}
CACHES["tokencount"] = _lengths.clear


def count_batch(column: pa.Array, path: str, batch_bytes: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of every row."""
    known = _lengths.get(path)
    if known is None or known.most != most:
        known = _lengths[path] = Lengths(path, most)
    data, offsets = text_bytes(column)
    counts = [known.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], batch_bytes) for a, b in row_blocks(offsets)]
    return np.diff(offsets), np.concatenate(counts) if counts else np.zeros(0, np.int64)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512, batch_bytes: int = 1 << 18, pieces_known: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, n = count_batch(b.column("text"), tokenizer_path, batch_bytes, pieces_known)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return arrow_map(docs_of(docs), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", "tokencount")
