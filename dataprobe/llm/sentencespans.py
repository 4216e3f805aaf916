"""Substring dedup over sliding runs of consecutive sentences.

From every sentence a run starts: the fewest sentences that are at least ``sentences`` many and hold at least
``words`` words. Runs are hashed (lower-cased words, so spacing and punctuation do not matter), joined over the
whole corpus, and each occurrence but the first (lowest id, then place) marks its sentences for removal.

With ``whole`` a run also ends at every sentence (the fewest sentences before it, by the same bounds), and a sentence
of at least ``words`` words is a run of its own. So every sentence of a repeated passage lies in a repeated run: one that
starts at it, one that ends at it, or, near both ends of a short passage, the one from the passage's first sentence.

A sentence ends at ``.``, ``!`` or ``?`` before white space and at a line break. A capital that follows a
lower-case word opens one too: pasted passages often lack the full stop before them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.text import Hashed, chunks, column, encode, keyed, same_row
from dataprobe.scratch import materialise

SENTENCES = 2
WORDS = 25

_END = np.isin(np.arange(256), [ord(c) for c in ".!?"])
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def _capital(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the letter at each byte is a capital of ASCII or of U+00C0 to U+00DE."""
    first, second = a[at], a[np.minimum(at + 1, len(a) - 1)]
    return ((first >= 65) & (first <= 90)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97))


def sentence_starts(w: Hashed) -> np.ndarray:
    """Index of the first word of every sentence of every text."""
    n = len(w.h)
    if n == 0:
        return np.zeros(0, np.int64)
    a = np.frombuffer(w.src, dtype=np.uint8)

    def between(mask: np.ndarray) -> np.ndarray:
        seen = np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])
        return seen[w.start[1:]] > seen[w.end[:-1]]

    cap = _capital(a, w.start)
    opens = between(a == 10) | (between(_END[a]) & between(_SPACE[a])) | (cap[1:] & ~cap[:-1])
    opens |= w.doc[1:] != w.doc[:-1]
    return np.concatenate([[0], np.flatnonzero(opens) + 1])


def _runs(w: Hashed, sentences: int, words: int, whole: bool):
    """(hash, text, first sentence, last sentence) of every run; sentences counted within their text."""
    s = sentence_starts(w)
    end = np.append(s[1:], len(w.h))
    first = np.arange(len(s))
    last = np.maximum(np.searchsorted(end, s + words), first + sentences - 1)
    if whole:
        back = np.minimum(np.searchsorted(s, end - words, "right") - 1, first - sentences + 1)
        alone = np.flatnonzero(end - s >= words)
        first, last = np.concatenate([first, back, alone]), np.concatenate([last, first, alone])
    ok = (first >= 0) & (last < len(s))
    first, last = first[ok], last[ok]
    inside = w.doc[s[first]] == w.doc[s[last]]
    # a run found from both ends is one occurrence
    first, last = np.divmod(np.unique(first[inside] * len(s) + last[inside]), max(len(s), 1))
    doc = w.doc[s[first]]
    base = np.searchsorted(s, w.first[doc])
    return w.spans(s[first], end[last]), doc, first - base, last - base


def runs(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sentences: int = SENTENCES, words: int = WORDS, whole: bool = False) -> DataFrame:
    """doc_id, _key, run (hash), first and last sentence of every run of every text."""
    base = keyed(docs, doc_id, text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws, names, keys = [encode(t) for t in column(b, "text")], b.column(0), b.column(1)
            for lo, hi in chunks(raws):
                h, doc, first, last = _runs(Hashed(raws[lo:hi]), sentences, words, whole)
                rows = pa.array(doc + lo)
                yield pa.RecordBatch.from_arrays([names.take(rows), keys.take(rows), pa.array(h.view(np.int64)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["doc_id", "_key", "run", "first", "last"])

    return base.mapInArrow(scan, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, _key long, run long, first int, last int")


def repeated(docs: DataFrame, **kw) -> DataFrame:
    """One row per text with repeats: doc_id, _key, spans (array of first and last sentence, to be removed) and
    sources (ids that hold the first occurrences)."""
    every = materialise(runs(docs, **kw), "runs")
    place = F.struct("doc_id", "_key", "first")
    # only hashes are shuffled to find what repeats; written, so that Spark can split the rows of a hot run
    known = materialise(every.groupBy("run").agg(F.count("*").alias("_n")).filter("_n > 1").select("run"), "known")
    held = materialise(every.join(known, "run"), "held")
    firsts = materialise(held.groupBy("run").agg(F.min(place).alias("_f")), "firsts")
    later = held.join(firsts, "run").filter(~place.eqNullSafe(F.col("_f")))
    return later.groupBy("doc_id", "_key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("spans"), F.array_sort(F.collect_set("_f.doc_id")).alias("sources"))


def _cut(raws: list[bytes], spans: list) -> tuple[list[bytes], list[int], list[int]]:
    texts, total, gone = [], [], []
    for lo, hi in chunks(raws):
        w = Hashed(raws[lo:hi])
        s = sentence_starts(w)
        starts = w.start[s]
        bounds = np.searchsorted(s, w.first)
        for i in range(lo, hi):
            a, b = bounds[i - lo], bounds[i - lo + 1]
            total.append(int(b - a))
            if not spans[i]:
                texts.append(raws[i])
                gone.append(0)
                continue
            drop = np.zeros(b - a + 1, np.int32)
            for x in spans[i]:
                drop[x["first"]] += 1
                drop[x["last"] + 1] -= 1
            keep = np.cumsum(drop[:-1]) == 0
            edge = np.append(starts[a:b] - w.at[i - lo], len(raws[i]))
            edge[0] = 0
            texts.append(b"".join(raws[i][edge[k] : edge[k + 1]] for k in np.flatnonzero(keep)))
            gone.append(int((~keep).sum()))
    return texts, total, gone


def remove_repeats(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """Each row's id, n_sentences, n_removed, removed (spans of sentences, from 0), sources and the text that stays.

    A sentence goes with the white space after it. Null or wordless texts hold no run and stay as they are (null
    becomes empty); texts shorter than a run are kept. Rows with equal id and text count as one document, so they
    do not repeat each other. Null ids come first. A passage that very many texts share is one key of a join
    whose large partitions Spark splits; no group of texts is gathered.
    """
    base = keyed(docs, doc_id, text)
    found = repeated(docs, doc_id=doc_id, text=text, **kw)
    both = base.join(found, same_row(base, found), "left").select(base["doc_id"], base["text"], "spans", "sources")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws, spans = [encode(t) for t in column(b, "text")], column(b, "spans")
            texts, total, gone = _cut(raws, spans)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), b.column(2), b.column(3), pa.array([t.decode("utf-8", "surrogatepass") for t in texts])], ["doc_id", "n_sentences", "n_removed", "removed", "sources", "text"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(scan, f"doc_id {kind}, n_sentences long, n_removed long, removed array<struct<first:int,last:int>>, sources array<{kind}>, text string")
