"""Near-duplicate documents by order MinHash, verified by banded alignment.

Texts are sequences of words; items are their runs of five words, each labelled with how often it has occurred
before. A sketch takes the four smallest hashes of a text's labelled items and keeps them in text order, so two
texts get the same sketch only if they share these items in the same order. Texts that agree in one of
``sketches`` sketches are compared: similarity is 1 - edit distance / length over the two sequences of five-word
runs, found by an alignment within the band that ``similarity`` allows.

Equal word sequences are one node from the start, and each bucket of equal sketches compares its nodes with its
smallest one. Where buckets still hold several components, the rest is joined exactly: a pair at the threshold shares
most of its items, so it shares one of each text's few rarest items (a fifth of them and one more, rarest first by
exact counts over these texts). Texts that merely share a passage have rare items of their own and do not meet. Again each
such item compares its texts with one of them, its hub, which then leaves; items that still hold several components go
on with more hubs, until none is left. So a group of near copies costs a few comparisons per member, and two texts that
are not similar are compared only if four fifths of each are as common as the item they share. A pair at similarity 0.8 shares two thirds of its items and misses
all 32 sketches once in about a thousand cases; at 0.9 once in 10^7. Short texts, where a single edit is all that is
allowed, would miss them more often: they also meet in buckets of their sequences with one run left out, which finds
every such pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataprobe.llm.components import components
from dataprobe.llm.text import CHUNK_BYTES, Hashed, column, encode, free_names, keyed, mix, portions, same_row
from dataprobe.scratch import materialise

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES = 32
KEPT = 4
#: a rare item compares its texts with one of them first, then with this many times as many each turn
HUB_GROWTH = 16


def _items(w: Hashed, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the labelled runs in text order; a text of fewer words is one run."""
    g, inside = w.grams(shingle)
    at = np.flatnonzero(inside)
    n = np.diff(w.first)
    few = np.flatnonzero((n > 0) & (n < shingle))
    h = np.concatenate([g[at], w.spans(w.first[few], w.first[few + 1])])
    doc = np.concatenate([w.doc[at], few])
    order = np.argsort(doc, kind="stable")
    h, doc = h[order], doc[order]
    by = np.lexsort((h, doc))  # stable: equal items of a text stay in text order
    new = np.ones(len(by), bool)
    new[1:] = (h[by][1:] != h[by][:-1]) | (doc[by][1:] != doc[by][:-1])
    nth = np.empty(len(by), np.uint64)
    nth[by] = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    return mix(h + nth * np.uint64(0x9FB21C651E98DF25)), doc


def sketch(h: np.ndarray, doc: np.ndarray, texts: int, sketches: int, kept: int) -> np.ndarray:
    """A row of ``sketches`` 64-bit sketches for each text; meaningless where a text has no item."""
    out = np.zeros((texts, sketches), np.uint64)
    n = np.bincount(doc, minlength=texts)
    # about 16 of a text's items lie below its bar; texts with fewer than ``kept`` below it take all
    bar = np.where(n <= 32, 2.0**64, 2.0**64 * 16 / np.maximum(n, 1))
    bar = np.minimum(bar, float(2**64 - 2048)).astype(np.uint64)[doc]
    need = np.minimum(n, kept)
    for t in range(sketches):
        x = (h ^ mix(np.uint64([t + 1]))[0]) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        low = x <= bar
        short = np.bincount(doc[low], minlength=texts) < need
        if short.any():
            low |= short[doc]
        at = np.flatnonzero(low)
        d = doc[at]
        by = np.lexsort((x[at], d))
        first = np.searchsorted(d[by], np.arange(texts))
        place = np.arange(len(by)) - first[d[by]]
        chosen = np.sort(at[by[place < kept]])  # back to text order
        d = doc[chosen]
        nth = np.arange(len(chosen)) - np.searchsorted(d, np.arange(texts))[d]
        value = np.full(texts, t + 1, np.uint64)
        for k in range(kept):
            here = nth == k
            value[d[here]] = mix(value[d[here]] * np.uint64(0xC2B2AE3D27D4EB4F) + h[chosen[here]])
        out[:, t] = value
    return out


def _one_left_out(w: Hashed, shingle: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(key, text): each short text's sequence of runs, whole and with each run left out.

    Short are texts that may differ in one run, and those a run shorter. Two of them within one edit share a key: the
    runs that stay, where one is replaced, or the whole shorter one, where one is added.
    """
    g, _ = w.grams(shingle)
    size = np.diff(w.first) - shingle + 1
    keys, texts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    n = 1
    while _most(n, similarity) < 2 and n <= int(size.max(initial=0)):
        here = np.flatnonzero(size == n) if _most(n + 1, similarity) else np.zeros(0, np.int64)
        if len(here):
            runs = g[w.first[here][:, None] + np.arange(n)]
            for out in range(n + 1) if _most(n, similarity) else [n]:  # n: none is left out
                key = np.full(len(here), 0x5851F42D4C957F2D, np.uint64)
                for j in range(n):
                    if j != out:
                        key = mix(key * np.uint64(0xC2B2AE3D27D4EB4F) + runs[:, j])
                keys.append(key)
                texts.append(here)
        n += 1
    return np.concatenate(keys), np.concatenate(texts)


def distance_within(a: list[int], b: list[int], most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``, else None.

    Columns of the alignment table are bit vectors of the 2 * most + 1 rows around the diagonal: differences to the
    cell above, one bit for +1 and one for -1 (Myers; banded after Hyyro).
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    cut = 0
    while cut < min(len(a), len(b)) - lo and a[-1 - cut] == b[-1 - cut]:
        cut += 1
    a, b = a[lo : len(a) - cut], b[lo : len(b) - cut]
    if abs(len(a) - len(b)) > most:
        return None
    if not a or not b:
        return len(a) + len(b)
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    most = min(most, n)
    rows: dict[int, int] = {}
    for i, x in enumerate(a):
        rows[x] = rows.get(x, 0) | 1 << i
    top = 2 * most
    full = (1 << top + 1) - 1
    up, down = ((1 << most + 1) - 1) << most, 0
    score = most
    for j in range(1, m + 1):
        x = rows.get(b[j - 1], 0)
        if x:
            shift = j - most - 1
            x = (x >> shift if shift >= 0 else x << -shift) & full
        d = ((((x & up) + up) ^ up) | x | down) & full
        right = down | (full & ~(d | up))
        left = d & up
        if j + most <= n:
            score += 1 - (d >> top & 1)
        else:
            at = n - j + most
            score += (right >> at & 1) - (left >> at & 1)
        up = left | (full & ~(d >> 1 | right))
        down = d >> 1 & right
    return score if score <= most else None


def _runs(x: np.ndarray, shingle: int) -> np.ndarray:
    """Hashes of the runs of ``shingle`` words; a shorter text is one run."""
    n = max(len(x) - shingle + 1, 1)
    out = np.zeros(n, np.int64)
    for j in range(min(shingle, len(x))):
        out = out * np.int64(0x2545F4914F6CDD1D) + x[j : j + n]
    return out


def similar(a: np.ndarray, b: np.ndarray, shingle: int, similarity: float) -> bool:
    """Whether two word sequences reach ``similarity`` over their runs of ``shingle`` words."""
    x, y = _runs(a, shingle), _runs(b, shingle)
    longest = max(len(x), len(y))
    most = _most(longest, similarity)
    if abs(len(x) - len(y)) > most:
        return False
    # items in common bound the distance from below
    u, cu = np.unique(x, return_counts=True)
    v, cv = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    if longest - int(np.minimum(cu[i], cv[j]).sum()) > most:
        return False
    return distance_within(x.tolist(), y.tolist(), most) is not None


def _most(n: int, similarity: float) -> int:
    """The largest distance that similar texts of ``n`` runs may have."""
    return int(np.floor((1 - similarity) * n + 1e-9))


def _nodes(base: DataFrame, shingle: int, sketches: int, kept: int, similarity: float) -> DataFrame:
    """doc_id, _key, node (hash of the word sequence), n_words and the sketches of every row, with the keys of short texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            w = Hashed([encode(t) for t in column(b, "text")])
            h, doc = _items(w, shingle)
            s = sketch(h, doc, b.num_rows, sketches, kept)
            n = np.diff(w.first)
            node = w.spans(w.first[:-1], w.first[1:]).view(np.int64)
            some = np.flatnonzero(n > 0)
            key, of = _one_left_out(w, shingle, similarity)
            of = np.concatenate([np.repeat(some, sketches), of])
            by = np.argsort(of, kind="stable")
            flat = pa.array(np.concatenate([s[some].ravel(), key])[by].view(np.int64))
            offsets = pa.array(np.searchsorted(of[by], np.arange(len(n) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "_key", "node", "n_words", "sketches"])

    return base.mapInArrow(scan, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, _key long, node long, n_words int, sketches array<long>")


def _sequences(texts: DataFrame) -> DataFrame:
    """node, words (hashes in order) of one text per node."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            w = Hashed([encode(t) for t in column(b, "text")])
            short = (w.h >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(short))], ["node", "words"])

    return texts.select("node", "text").mapInArrow(scan, "node long, words array<int>")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, sequences: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sequences are similar."""
    left = sequences.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    right = sequences.select(F.col("node").alias("b"), F.col("words").alias("wb"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                ok.append(similar(x.values.to_numpy().astype(np.int64), y.values.to_numpy().astype(np.int64), shingle, similarity))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(scan, "a long, b long")


def _labelled(x: np.ndarray, shingle: int) -> np.ndarray:
    """The runs of one text, each told apart from its earlier occurrences."""
    runs = _runs(x, shingle)
    by = np.argsort(runs, kind="stable")
    new = np.ones(len(by), bool)
    new[1:] = runs[by][1:] != runs[by][:-1]
    nth = np.arange(len(by)) - np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    return mix(runs[by].view(np.uint64) + nth.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def _rare_items(sequences: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """item, node, n: the rarest items of each text that two similar texts cannot both miss, as far as others hold them.

    Rarity is the exact number of texts that hold an item. Items of one text alone come first in the order and meet
    nobody, so only their number matters.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "words", CHUNK_BYTES // 8):
            items = [_labelled(x.values.to_numpy().astype(np.int64), shingle) for x in b.column(1)]
            sizes = np.array([len(h) for h in items], np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *items]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(flat), pa.array(np.repeat(b.column(0).to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes))], ["item", "node", "n"])

    every = sequences.select("node", "words").mapInArrow(scan, "item long, node long, n int")
    # written, so that Spark can split the rows of a hot item
    counts = materialise(every.groupBy("item").agg(F.count("*").alias("c")).filter("c > 1"), "item-counts")
    shared = every.join(counts, "item").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("c", "item"))).alias("s"))
    most = F.floor((1 - similarity) * F.col("n") + 1e-9).cast("int") + 1 - (F.col("n") - F.size("s"))
    return shared.filter(most > 0).select(F.explode(F.slice("s", 1, F.greatest(most, F.lit(0)))).alias("i"), "node", "n").select("i.item", "node", "n")


def _placed(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _apart(placed: DataFrame, key: str) -> DataFrame:
    """The rows whose key holds several components."""
    mixed = placed.groupBy(key).agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo < _hi").select(key)
    return placed.join(materialise(mixed, "mixed"), key)


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` after further links: components of the components."""
    tops = links.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    tops = tops.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct()
    up = components(tops)
    known = roots.unionByName(up.select("node", F.col("node").alias("root"))).distinct()
    up = up.select(F.col("node").alias("root"), F.col("root").alias("_up"))
    return materialise(known.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root")), "labels")


def near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, sketches: int = SKETCHES, kept: int = KEPT) -> DataFrame:
    """One row per row: doc_id, _key, n_words, class_id (the smallest doc_id of its class), class_size, stays.

    Classes are the connected components of the verified pairs; copies with equal words share a class. Texts
    without words (null or empty) are copies of each other; texts of fewer than five words are similar only if
    equal. The row with the smallest id stays; rows repeated with the same id and text all count as that row. Null
    ids come first. An empty table gives no rows.
    """
    base = keyed(docs, doc_id, text)
    rows = materialise(_nodes(base, shingle, sketches, kept, similarity), "sketches")
    buckets = rows.groupBy("node").agg(F.first("sketches").alias("s")).select("node", F.explode("s").alias("bucket"))
    # written, so that the join shuffles both sides and Spark can split the rows of a hot bucket
    several = materialise(buckets.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("bucket", "hub"), "hubs")
    members = materialise(buckets.join(several, "bucket"), "buckets")
    reps = rows.join(members.select("node").distinct(), "node").groupBy("node").agg(F.min(F.struct("doc_id", "_key")).alias("r")).select("node", "r.doc_id", "r._key")
    sequences = materialise(_sequences(base.join(reps, same_row(base, reps)).dropDuplicates(["node"])), "sequences")
    pairs = _ordered(members.filter("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    tried = materialise(pairs, "pairs")
    edges = materialise(_verified(tried, sequences, shingle, similarity), "links")
    roots = components(edges)
    apart = _apart(materialise(_placed(members.select("bucket", "node"), roots), "placed"), "bucket").select("node").distinct()
    items = materialise(_rare_items(sequences.join(apart, "node"), shingle, similarity), "rare-items")
    hubs = 1
    while True:
        here = materialise(_apart(materialise(_placed(items, roots), "placed"), "item"), "apart")
        if here.isEmpty():
            break
        turn = Window.partitionBy("item").orderBy(F.xxhash64("node"), "node")
        chosen = materialise(here.withColumn("r", F.row_number().over(turn)).filter(F.col("r") <= hubs).select("item", F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb")), "hubs")
        # no text whose length differs by more can be similar
        near = F.abs(F.col("n") - F.col("nb")) <= F.floor((1 - similarity) * F.greatest("n", "nb") + 1e-9)
        pairs = here.join(chosen, "item").filter((F.col("root") != F.col("rb")) & near)
        pairs = materialise(_ordered(pairs.select(F.col("node").alias("a"), "b")).join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.unionByName(pairs)
        links = materialise(_verified(pairs, sequences, shingle, similarity), "links")
        if not links.isEmpty():
            roots = _joined(roots, links)
        # a hub has met all of its item
        items = here.select("item", "node", "n").join(chosen.select("item", F.col("b").alias("node")), ["item", "node"], "left_anti")
        hubs *= HUB_GROWTH
    # one row per node before anything is joined, so that equal texts are one row; the rows themselves meet it once
    nodes = rows.groupBy("node").agg(F.min(F.struct("doc_id", "_key")).alias("_f"), F.count("*").alias("n")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = materialise(nodes, "nodes")
    classes = nodes.groupBy("root").agg(F.min("_f").alias("_f"), F.sum("n").alias("class_size"))
    placed = materialise(nodes.select("node", "root").join(classes, "root").drop("root"), "classes")
    out = rows.select("doc_id", "_key", "node", "n_words").join(placed, "node")
    return out.select("doc_id", "_key", F.col("n_words").cast("long").alias("n_words"), F.col("_f.doc_id").alias("class_id"), "class_size", F.struct("doc_id", "_key").eqNullSafe(F.col("_f")).alias("stays"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called; rows repeated with the same id and
    text once. Texts without words (null or empty) are one class, so one of them stays. An empty table gives no rows."""
    own, ident, key = free_names(docs, "_own", "_id", "_key")
    first = near_copies(docs, doc_id=doc_id, text=text, **kw).filter("stays").select(F.col("doc_id").alias(ident), F.col("_key").alias(key)).distinct()
    tagged = docs.withColumn(own, F.xxhash64(F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string")))
    return tagged.join(first, F.col(f"`{doc_id}`").eqNullSafe(F.col(ident)) & (F.col(own) == F.col(key)), "left_semi").dropDuplicates([doc_id, own]).drop(own)
