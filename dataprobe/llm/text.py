"""Words of whole texts and their 64-bit hashes, computed for many texts at once with numpy.

``words`` follow ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; ``tokens`` follow
``[^\\x20\\x09-\\x0D]+``. Both work on UTF-8 bytes: the classes split at ASCII bytes only, so bytes and
characters give the same words. Two different words get the same hash with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: bytes of text that are worked on at once; hashing keeps some forty bytes of arrays for each
CHUNK_BYTES = 500_000
_BASE = 0x9E3779B97F4A7C15
_SEED = 0x5851F42D4C957F2D
GRAM_BASE = np.uint64(0xD6E8FEB86659FD93)

#: A-Z to a-z, every other ASCII byte outside 0-9 a-z to a blank
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: A-Z to a-z, white space to a blank
TOKEN_BYTES = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))


def encode(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def words(text: str | None) -> list[bytes]:
    return encode(text).translate(WORD_BYTES).split()


def tokens(text: str | None) -> list[bytes]:
    return encode(text).translate(TOKEN_BYTES).split()


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_SEED))
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 65_536)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 4 * CHUNK_BYTES:
            _powers[name] = have
    return have[:n]


class Hashed:
    """The words of several texts: ``h`` their hashes in order, ``doc`` the text of each, ``first`` the index of
    each text's first word (one more entry than texts), ``start``/``end`` byte places in ``src``, ``at`` where each text begins there."""

    def __init__(self, raws: list[bytes], table: bytes = WORD_BYTES):
        self.src = b" ".join(raws)
        self.raw = self.src.translate(table)
        a = np.frombuffer(self.raw, dtype=np.uint8)
        inside = a != 32
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0) if len(a) else np.zeros(1, np.int8)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.at = np.concatenate([[0], np.cumsum([len(r) + 1 for r in raws])]).astype(np.int64)
        self.first = np.searchsorted(self.start, self.at)
        self.doc = np.repeat(np.arange(len(raws)), np.diff(self.first))
        total = np.zeros(len(a) + 1, dtype=np.uint64)
        if len(a):
            np.cumsum(_BYTE_VALUE[a] * _power("up", _BASE, len(a)), out=total[1:])
        h = (total[self.end] - total[self.start]) * _power("down", _INVERSE, len(a) + 1)[self.start]
        self.h = mix(h ^ (self.end - self.start).astype(np.uint64))

    def spans(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of the words lo <= i < hi, whatever their number, from sums that run over all words."""
        n = len(self.h)
        total = np.zeros(n + 1, dtype=np.uint64)
        if n:
            np.cumsum(self.h * _power("gram", int(GRAM_BASE), n), out=total[1:])
        return mix((total[hi] - total[lo]) * _power("gram-down", pow(int(GRAM_BASE), -1, 1 << 64), n + 1)[lo] + (hi - lo).astype(np.uint64))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``k`` words, by the index of the first word, and which stay inside one text."""
        n = len(self.h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        g = np.full(n, k, dtype=np.uint64)
        for j in range(k):
            g = g * GRAM_BASE + self.h[j : n + j]
        return mix(g), self.doc[:n] == self.doc[k - 1 :]


def chunks(raws: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes; a longer text stands alone."""
    lo, size = 0, 0
    for i, r in enumerate(raws):
        if size and size + len(r) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(r) + 1
    if lo < len(raws):
        yield lo, len(raws)


def portions(batches: Iterator[pa.RecordBatch], name: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """All rows in order, in slices of at most ``limit`` bytes of texts (elements of lists) in column ``name``; a longer
    one stands alone. Spark's batches go by rows, so Python objects and arrays of a whole batch would grow with its texts."""
    for b in batches:
        c = b.column(b.schema.get_field_index(name))
        n = pc.list_value_length(c) if pa.types.is_list(c.type) else pc.binary_length(c)
        end = np.cumsum(pc.fill_null(n, 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        lo, before = 0, 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(end, before + limit, side="right")))
            yield b.slice(lo, hi - lo)
            lo, before = hi, end[hi - 1]


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``_key`` and ``text`` only. Ids may repeat or be null: rows with the same id and text share a
    key, all others differ in id or key, so results are joined back on both."""
    ident, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    return df.select(ident.alias("doc_id"), F.xxhash64(ident, text).alias("_key"), text.alias("text"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["_key"] == b["_key"])
