"""Benchmark decontamination by winnowing.

Of every run of six consecutive 8-word hashes the smallest is kept, so any 13 words that a document shares with
an item share at least one kept hash. Items shorter than 13 words are fingerprinted whole and compared with every
run of their length. A bitmap of fixed size over the item hashes (``bits``, the same number of bytes at every
benchmark size) lets documents send only probable hits to the join; a full bitmap costs time, never a hit. Each
fingerprint carries the words around it, so hits are extended inside the join, without fetching texts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.text import Hashed, column, encode, free_names, keyed, mix, portions, same_row
from dataprobe.scratch import materialise

WINDOW = 13
GRAM = 8
BITS = 1 << 24


def _selected(w: Hashed, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept fingerprints and the index of their first word."""
    g, inside = w.grams(gram)
    n = len(w.h) - window + 1
    if n <= 0:
        return g[:0], np.zeros(0, np.int64)
    span = window - gram + 1
    low = g[:n].copy()
    for j in range(1, span):
        np.minimum(low, g[j : n + j], out=low)
    low[w.doc[:n] != w.doc[window - 1 :]] = 0  # windows across two texts select nothing
    high = np.zeros(len(g), np.uint64)
    for j in range(span):
        np.maximum(high[j : n + j], low, out=high[j : n + j])
    at = np.flatnonzero((high == g) & inside & (high != 0))
    return g[at], at


def _context(w: Hashed, at: np.ndarray, before: int, width: int) -> np.ndarray:
    """Word hashes around each place; 0 outside the text."""
    place = at[:, None] + np.arange(-before, width - before)[None, :]
    doc = w.doc[at]
    ok = (place >= w.first[doc][:, None]) & (place < w.first[doc + 1][:, None])
    return np.where(ok, w.h[np.clip(place, 0, max(len(w.h) - 1, 0))], np.uint64(0))


def _prints(w: Hashed, gram: int, window: int, lengths: list[int], items: bool) -> Iterator[tuple]:
    """(fingerprint, first word, context) for whole windows, then for each short length."""
    width, before = 2 * window - gram, window - gram
    n = np.diff(w.first)
    fp, at = _selected(w, gram, window)
    yield fp, at, before, width
    for k in lengths:
        g, inside = w.grams(k)
        keep = inside & (n[w.doc[: len(g)]] == k) if items else inside
        at = np.flatnonzero(keep)
        yield mix(g[at] + np.uint64(1)), at, 0, k


def _rows(w: Hashed, ids: list, fp, at, before, k, width) -> dict:
    ctx = np.zeros((len(at), width), np.uint64)
    ctx[:, :k] = _context(w, at, before, k)
    doc = w.doc[at]
    return {
        "fp": fp.view(np.int64), "row": [ids[d] for d in doc], "at": (at - w.first[doc]).astype(np.int32),
        "short": np.full(len(at), 0 if before else k, np.int32), "ctx": list(ctx.view(np.int64)),
    }


def item_prints(items: DataFrame, item_id: str, text: str, gram: int, window: int) -> DataFrame:
    """One row per kept fingerprint of an item: fp, item_id, i_at, short (0, or the item's length below the window), i_ctx."""
    kind = items.schema[item_id].dataType
    ids = items.select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            names, w = column(b, "item_id"), Hashed([encode(t) for t in column(b, "text")])
            for fp, at, before, k in _prints(w, gram, window, list(range(1, window)), True):
                d = _rows(w, names, fp, at, before, k, 2 * window - gram)
                yield pa.RecordBatch.from_pydict({"fp": d["fp"], "item_id": pa.array(d["row"], b.schema.field("item_id").type), "i_at": d["at"], "short": d["short"], "i_ctx": pa.array(d["ctx"], pa.list_(pa.int64()))})

    return ids.mapInArrow(scan, f"fp long, item_id {kind.simpleString()}, i_at int, short int, i_ctx array<long>")


def _bitmap(prints: DataFrame, bits: int) -> np.ndarray:
    """A bit for each item fingerprint modulo ``bits``: at most bits/64 rows come to the driver."""
    filled = prints.select(F.expr(f"cast(pmod(fp, {bits}) div 64 as int)").alias("s"), F.expr("shiftleft(1L, cast(pmod(fp, 64) as int))").alias("b"))
    rows = filled.groupBy("s").agg(F.bit_or("b").alias("b")).collect()
    out = np.zeros(bits // 64, np.int64)
    for r in rows:
        out[r["s"]] = r["b"]
    return out.view(np.uint64)


def hits(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, gram: int = GRAM, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(documents, spans): ``doc_id, _key, n_words`` per row and ``doc_id, _key, item_id, first, last`` (words from 0,
    last excluded) per run of document words inside occurrences of an item's windows."""
    prints = item_prints(items, item_id, item_text, gram, window).persist()
    bitmap = _bitmap(prints, bits)
    lengths = [r[0] for r in prints.select("short").filter("short > 0").distinct().collect()]  # fewer than ``window`` values
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)
    base = keyed(docs, doc_id, text)
    width = 2 * window - gram
    kind = base.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            names, keys, w = column(b, "doc_id"), column(b, "_key"), Hashed([encode(t) for t in column(b, "text")])
            m = b.num_rows
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column(b.schema.get_field_index("doc_id")), "_key": b.column(b.schema.get_field_index("_key")), "n_words": np.diff(w.first).astype(np.int64),
                "fp": pa.nulls(m, pa.int64()), "d_at": pa.nulls(m, pa.int32()), "d_ctx": pa.nulls(m, pa.list_(pa.int64())),
            })
            for fp, at, before, k in _prints(w, gram, window, lengths, False):
                slot = (fp.view(np.int64) % bits).astype(np.int64)
                ok = (shared.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
                if ok.any():
                    d = _rows(w, names, fp[ok], at[ok], before, k, width)
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(d["row"], b.schema.field("doc_id").type), "_key": pa.array([keys[x] for x in w.doc[at[ok]]], pa.int64()), "n_words": pa.nulls(len(d["row"]), pa.int64()),
                        "fp": d["fp"], "d_at": d["at"], "d_ctx": pa.array(d["ctx"], pa.list_(pa.int64())),
                    })

    both = materialise(base.mapInArrow(scan, f"doc_id {kind}, _key long, n_words long, fp long, d_at int, d_ctx array<long>"), "winnow")
    found = both.filter("fp is not null").drop("n_words").join(prints, "fp")
    before = window - gram
    same = F.zip_with("d_ctx", "i_ctx", lambda a, b: (a == b) & (b != 0))
    run = lambda part: F.coalesce(F.array_position(F.concat(part, F.array(F.lit(False))), False) - 1, F.lit(0)).cast("int")
    found = found.withColumn("_same", same)
    left = run(F.reverse(F.slice("_same", 1, before))) if before else F.lit(0)
    long = (
        found.filter((F.col("short") == 0) & F.forall(F.slice("_same", before + 1, gram), lambda x: x))
        .withColumn("_l", left).withColumn("_r", run(F.slice("_same", before + gram + 1, before)) if before else F.lit(0))
        .filter(F.col("_l") + F.col("_r") + gram >= window)
        .select("doc_id", "_key", "item_id", (F.col("d_at") - F.col("_l")).alias("first"), (F.col("d_at") + gram + F.col("_r")).alias("last"))
    )
    short = found.filter("short > 0 and forall(slice(_same, 1, short), x -> x)").select("doc_id", "_key", "item_id", F.col("d_at").alias("first"), (F.col("d_at") + F.col("short")).alias("last"))
    return both.filter("fp is null").select("doc_id", "_key", "n_words"), long.unionByName(short)


def contamination(docs: DataFrame, items: DataFrame, *, share: float = 0.05, **kw) -> DataFrame:
    """One row per document row: doc_id, _key, n_words, n_hit, items (sorted as text), contaminated (hit words are
    at least ``share`` of all).

    Null or empty texts have no words and are not contaminated; null items are empty; an empty benchmark hits
    nothing. Repeated rows get the same result each.
    """
    rows, spans = hits(docs, items, **kw)
    # spans of a row are bounded by its words; a passage that many rows share stays spread over rows
    covered = (
        spans.groupBy("doc_id", "_key").agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias("s"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
        .withColumn("n_hit", F.expr("aggregate(s, named_struct('n', 0L, 'to', 0), (a, x) -> named_struct('n', a.n + greatest(0, x.last - greatest(x.first, a.to)), 'to', greatest(a.to, x.last)), a -> a.n)"))
        .select("doc_id", "_key", "items", "n_hit")
    )
    out = rows.join(covered, same_row(rows, covered), "left").select(rows["doc_id"], rows["_key"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    per = round(1 / share)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (per * F.col("n_hit") >= F.col("n_words")))


def digest(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    out = contamination(docs, items, **kw)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def clean(docs: DataFrame, items: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, whatever these are called.

    Null and empty texts stay; repeated rows stay or go together; an empty table gives no rows.
    """
    id_col, text_col = kw.get("doc_id", "doc_id"), kw.get("text", "text")
    own, other, key = free_names(docs, "_own", "_id", "_key")
    bad = contamination(docs, items, **kw).filter("contaminated").select(F.col("doc_id").alias(other), F.col("_key").alias(key)).distinct()
    ident = F.col(f"`{id_col}`")
    tagged = docs.withColumn(own, F.xxhash64(ident, F.col(f"`{text_col}`").cast("string")))
    return tagged.join(bad, ident.eqNullSafe(F.col(other)) & (F.col(own) == F.col(key)), "left_anti").drop(own)
