"""Best-fit packing of whole documents into sequences of fixed capacity.

Only documents longer than the capacity are cut. Packing looks at lengths alone, and there are at most
``capacity`` different ones, so the plan is made from the count of each length (a table that does not grow with
the corpus) and says which ranks of a length go to which sequences:

* lengths above a third of the capacity: at most two share a sequence. From the longest on, each is matched with
  the longest one that still fits beside it (a greedy matching, exact counts at a time);
* the other lengths, from the longest on, go to the smallest gap that holds them, else open new sequences.

Each piece's rank within its length is its place in its task plus the count of that length in earlier tasks.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dataprobe.llm.text import column, encode, portions
from dataprobe.scratch import materialise

CAPACITY = 4096
END = 1
#: words whose ids a worker remembers
CACHE_WORDS = 300_000

#: lower-case letters that no normalisation changes
_LETTERS = re.compile(f"[{''.join(c for c in map(chr, range(0x180)) if c.isalpha() and c.lower() == c)}]+")
_PLAIN = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:-;=-@\[-`{}~]*)")


class WordIds:
    """Token ids of white-space separated words, remembered per worker.

    The vocabulary's tokenizer drops white space before anything else, so a text's ids are its words' ids one
    after the other. A word of letters with ASCII punctuation behind it (neither apostrophe nor digit) is the
    letters' pieces, then the punctuation's; other words go through the whole tokenizer. Half of a corpus' different
    words occur once, so a full memory keeps the words used most and forgets the rest.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.flat, self.begin = array("I"), array("q", [0])
        self.uses = np.zeros(0, np.int64)

    def trim(self) -> None:
        """Half of the words stay, those used most; older uses count half."""
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: CACHE_WORDS // 2])
        words = list(self.place)  # in the order of their places
        begin = np.frombuffer(self.begin, np.int64)
        n = begin[keep + 1] - begin[keep]
        out = np.cumsum(np.append(0, n))
        pick = np.arange(out[-1]) - np.repeat(out[:-1] - begin[keep], n)
        flat = np.frombuffer(self.flat, np.uint32)[pick]
        self.place = {words[k]: i for i, k in enumerate(keep.tolist())}
        self.flat, self.begin = array("I", flat.tobytes()), array("q", out.tobytes())
        self.uses = self.uses[keep] // 2

    def _model(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece)]

    def _letters(self, stem: bytes) -> list[int] | None:
        """The ids of letters, remembered ones if they are a word that was seen; None if the whole tokenizer must say them."""
        if stem.isascii():
            piece = stem.decode()
        else:
            if not _LETTERS.fullmatch(stem.decode("utf-8", "surrogatepass")):
                return None
            piece = stem.decode("latin-1").translate(_VISIBLE)
        k = self.place.get(stem)
        return self._model(piece) if k is None else self.flat[self.begin[k] : self.begin[k + 1]].tolist()

    def _word(self, word: bytes) -> list[int]:
        m = _PLAIN.fullmatch(word)
        ids = self._letters(m[1]) if m else None
        if ids is None:
            return self.whole.encode(word.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids
        return ids + self._model(m[2].decode()) if m[2] else ids

    def learn(self, words: list[bytes]) -> None:
        if len(self.place) > CACHE_WORDS:
            self.trim()
        for word in set(words).difference(self.place):
            self.flat.extend(self._word(word))
            self.place[word] = len(self.begin) - 1
            self.begin.append(len(self.flat))

    def texts(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each text's begin (one more entry than texts)."""
        split = [(r if b"<|" in r else r.lower()).split() for r in raws]
        words = list(chain.from_iterable(split))
        self.learn(words)
        count = np.cumsum([0, *map(len, split)])
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        uses = np.bincount(at, minlength=len(self.place))
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        begin = np.frombuffer(self.begin, np.int64)
        n = begin[at + 1] - begin[at]
        out = np.cumsum(np.append(0, n))
        pick = np.arange(out[-1]) - np.repeat(out[:-1] - begin[at], n)
        return np.frombuffer(self.flat, np.uint32)[pick] if len(pick) else np.zeros(0, np.uint32), out[count]


def _visible_bytes() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte: itself where printable in
    Latin-1, else the next free one from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(rest)}


_VISIBLE = _visible_bytes()
_workers: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]


def pieces(docs: DataFrame, tokenizer: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, task and rank (place among the pieces of its length
    in its task); with ``ids`` the token ids too."""
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        coder = _word_ids(tokenizer)
        for b in portions(batches, "text"):
            flat, first = coder.texts([encode(t) for t in column(b, "text")])
            rows, piece, start, length, crc, rank, kept = [], [], [], [], [], [], []
            for i in range(b.num_rows):
                own = np.append(flat[first[i] : first[i + 1]], np.uint32(end)).astype("<u4")
                for k, s in enumerate(range(0, len(own), capacity)):
                    part = own[s : s + capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    rank.append(seen[len(part)])
                    seen[len(part)] += 1
                    if ids:
                        kept.append(part.astype(np.int32))
            cols = {
                "doc_id": b.column(0).take(pa.array(rows, pa.int64())), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()), "task": pa.array([task] * len(rows), pa.int32()), "rank": pa.array(rank, pa.int64()),
            }
            if ids:
                cols["ids"] = pa.array(kept, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(cols)

    schema = f"doc_id {base.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids array<int>" * ids
    return base.mapInArrow(scan, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, rank, count, per, sequence, offset): the ``count`` pieces of ``length`` from ``rank`` on
    fill sequences from ``sequence`` on, ``per`` in each, from ``offset`` on."""
    left = {k: n for k, n in counts.items() if n > 0 and k > 0}
    used = dict.fromkeys(left, 0)
    made: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> ranges of sequences (first, number)
    order: list[int] = []  # the gaps in use, ascending
    following = 0

    def place(length: int, bins: int, per: int, sequence: int, gap: int, most: int) -> None:
        """Put ``per`` pieces into each of ``bins`` sequences with ``gap`` free; ``most`` pieces in all."""
        made.append((length, used[length], most, per, sequence, capacity - gap))
        used[length] += most
        left[length] -= most

    def free(gap: int, sequence: int, bins: int) -> None:
        if gap > 0 and bins > 0:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((sequence, bins))

    large = sorted(k for k in left if 3 * k > capacity)
    for length in reversed(large):
        while left[length]:
            # the longest partner that fits; a length may be its own partner
            k = bisect_left(large, min(capacity - length, length) + 1) - 1
            while k >= 0 and (left[large[k]] == 0 or large[k] == length and left[length] < 2):
                k -= 1
            n = left[length]
            if k < 0:
                place(length, n, 1, following, capacity, n)
                free(capacity - length, following, n)
            elif large[k] == length:
                n //= 2
                place(length, n, 2, following, capacity, 2 * n)
                free(capacity - 2 * length, following, n)
            else:
                other = large[k]
                n = min(n, left[other])
                place(length, n, 1, following, capacity, n)
                place(other, n, 1, following, capacity - length, n)
                free(capacity - length - other, following, n)
            following += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            i = bisect_left(order, length)
            if i == len(order):
                per = capacity // length
                bins = -(-left[length] // per)
                free(capacity, following, bins)
                following += bins
                continue
            gap = order[i]
            sequence, bins = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(i)
            per = gap // length
            full = min(bins, left[length] // per)
            if full:
                place(length, full, per, sequence, gap, full * per)
                free(gap - per * length, sequence, full)
            if full < bins:
                rest = min(left[length], per - 1) if full * per or left[length] < per else 0
                if rest:
                    place(length, 1, rest, sequence + full, gap, rest)
                    free(gap - rest * length, sequence + full, 1)
                    full += 1
                free(gap, sequence + full, bins - full)
    return made


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, **kw) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids on request).

    Null texts are empty: their piece is the end id alone. Repeated rows are packed once each, null ids like others;
    an empty table gives no rows. Longer texts than the capacity are cut into full pieces and a rest.
    """
    spark = docs.sparkSession
    cut = materialise(pieces(docs, tokenizer, capacity=capacity, **kw), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("task", "length", "_before")
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    segments = np.array(sorted(plan(counts, capacity)), np.int64).reshape(-1, 6)
    first = np.searchsorted(segments[:, 0], np.arange(capacity + 2))
    shared = spark.sparkContext.broadcast((segments, first))
    ranked = cut.join(offsets, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("_before")).drop("task", "_before")
    names = [c for c in cut.columns if c not in ("task", "rank")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, begin = shared.value
        key = seg[:, 0] << 40 | seg[:, 1] if len(seg) else np.zeros(0, np.int64)
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy()
            rank = b.column(b.schema.get_field_index("rank")).to_numpy()
            s = seg[np.searchsorted(key, length << 40 | rank, side="right") - 1]
            nth = rank - s[:, 1]
            cols = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(s[:, 4] + nth // s[:, 3]), pa.array(s[:, 5] + nth % s[:, 3] * length)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in names)
    return ranked.select(*names, "rank").mapInArrow(scan, f"{schema}, sequence_id long, offset long")
