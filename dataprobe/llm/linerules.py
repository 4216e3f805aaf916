"""Quality rules with line sequence labelling.

Plain counts of a text decide first (too few words, too much repetition). For the rest a linear-chain conditional
random field labels each line content or boilerplate, decoded by Viterbi; a text is kept if content lines hold at
least ``share`` of its words.

The field is fitted on at most ``sample`` labelled documents (the smallest hashes). Their lines are labelled from
what is known of them: all lines of a low-quality document are boilerplate; in a good one those that repeat an
earlier line are, and the others are content.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.llm import crf
from dataprobe.llm.text import Hashed, chunks, column, encode

SAMPLE = 2_000
SHARE = 0.5
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

#: white space to a blank, all else as it is
_TABLE = bytes(32 if 9 <= c <= 13 else c for c in range(256))
_SYMBOLS = b"#*$%&|<>"
_CONTINUES = np.isin(np.arange(256), np.arange(0x80, 0xC0))
_UPPER, _DIGITS, _MARKS = bytes(range(65, 91)), bytes(range(48, 58)), b"!?|#*$%&<>=_~^"


def lines_of(raw: bytes) -> list[bytes]:
    """The lines that hold a word."""
    return [line for line in raw.split(b"\n") if line.translate(_TABLE).split()]


def line_features(lines: list[bytes]) -> list[list[float]]:
    out, seen = [], Counter()
    for line in lines:
        ws = line.split()
        n, size = len(ws), len(line)
        count = Counter(ws)
        share = lambda drop: (size - len(line.translate(None, drop))) / size
        out.append([
            math.log1p(n), share(_MARKS), share(_UPPER), share(_DIGITS), float(line.rstrip()[-1:] in b".!?:\"'"), sum(map(len, ws)) / n, max(count.values()) / n, len(count) / n,
            math.log1p(seen[line]), sum(map(bytes.__eq__, ws, ws[1:])) / n, float(b"|" in ws), float(b"@" in line or b"://" in line), sum(map(bytes.istitle, ws)) / n,
        ])
        seen[line] += 1
    return out


def base_counts(raws: list[bytes]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    m = len(raws)
    w = Hashed(raws, _TABLE)
    n = np.diff(w.first).astype(np.int64)
    a = np.frombuffer(w.raw, dtype=np.uint8)
    chars = np.concatenate([[0], np.cumsum((a != 32) & ~_CONTINUES[a])])
    edge = np.minimum(w.at, len(a))
    g, inside = w.grams(WINDOW)
    at = np.flatnonzero(inside)
    by = at[np.lexsort((g[at], w.doc[at]))]
    same = (g[by][1:] == g[by][:-1]) & (w.doc[by][1:] == w.doc[by][:-1])
    again = by[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(by) else by
    cover = np.zeros(len(w.h) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    dup = np.zeros(m, np.int64)
    for i, r in enumerate(raws):
        lines = lines_of(r)
        dup[i] = len(lines) - len(set(lines))
    return {
        "n_words": n, "word_chars": np.diff(chars[edge]), "n_symbols": np.array([len(r) - len(r.translate(None, _SYMBOLS)) for r in raws], np.int64), "n_dup_lines": dup,
        "n_repeat_words": np.bincount(w.doc[np.cumsum(cover)[:-1] > 0], minlength=m).astype(np.int64),
    }


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> crf.Chain | None:
    """The line model; None without labelled lines of both kinds."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    # at most ``sample`` rows of an id and a flag: the texts need no shuffle to find them; equal texts have one label, and ids
    # that repeat with different texts bring no more than ``sample`` of them
    train = texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("text"), "text").limit(sample).persist()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = [], []
            for t, quality in zip(column(b, "text"), column(b, "quality")):
                lines = lines_of(encode(t))
                seen: set[bytes] = set()
                ys.append([int(quality == 0 or line in seen or bool(seen.add(line))) for line in lines])
                xs.append(line_features(lines))
            yield pa.RecordBatch.from_arrays([pa.array(xs, pa.list_(pa.list_(pa.float64()))), pa.array(ys, pa.list_(pa.int32()))], ["x", "y"])

    rows = sorted(train.select("text", "quality").mapInArrow(scan, "x array<array<double>>, y array<int>").filter("size(y) > 0").collect())
    train.unpersist()
    ys = [np.array(r["y"]) for r in rows]
    if not rows or len(set(np.concatenate(ys).tolist())) < 2:
        return None
    return crf.fit([np.array(r["x"]) for r in rows], ys)


def label_lines(chain: crf.Chain | None, raws: list[bytes]) -> list[tuple[list[bytes], list[int]]]:
    """The lines of each text with 0 for content and 1 for boilerplate; without a model all is content."""
    lines = [lines_of(r) for r in raws]
    if chain is None:
        return [(x, [0] * len(x)) for x in lines]
    flat = [f for x in lines for f in line_features(x)]
    e = chain.emissions(np.array(flat)) if flat else np.zeros((0, 2))
    out, at = [], 0
    for x in lines:
        out.append((x, crf.viterbi(chain, e[at : at + len(x)])))
        at += len(x)
    return out


def judge(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", share: float = SHARE, chain: crf.Chain | None = None) -> DataFrame:
    """One row per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    content_share (of the words) and line_labels (0 content, 1 boilerplate, of the lines with a word).

    Null texts are empty and fail; repeated rows are judged each. Without labels every line is content.
    """
    chain = chain or fit(docs, labels, doc_id=doc_id, text=text)
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws = [encode(t) for t in column(b, "text")]
            for lo, hi in chunks(raws):
                c = base_counts(raws[lo:hi])
                failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
                found = label_lines(chain, raws[lo:hi])
                content = np.array([sum(len(line.translate(_TABLE).split()) for line, s in zip(*f) if s == 0) for f in found], np.float64)
                part = content / np.maximum(c["n_words"], 1)
                cols = {"doc_id": b.column(0).slice(lo, hi - lo)} | c | {"base_failed": failed, "kept": ~failed & (part >= share), "content_share": part, "line_labels": pa.array([f[1] for f in found], pa.list_(pa.int32()))}
                yield pa.RecordBatch.from_pydict(cols)

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(scan, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean, content_share double, line_labels array<int>")
