"""Line dedup by pairwise alignment.

A document overlaps an earlier one where they share lines. Each repeated line of at least ``words`` words names one
partner, the earliest document that holds it, so even a line that a third of all documents hold gives one pair per
document, and no cut-off on frequent lines is needed. Each pair is aligned with patience diff over the lines it
shares: lines that occur once in both are anchors, the longest ascending sequence of them holds, and the stretches
between are aligned the same way; where no line is unique, the rarest one is the anchor. Runs of aligned adjacent
lines that hold an anchor-worthy line are blocks, and are deleted from the later document.

With ``whole``, the lines that a document keeps although an earlier one holds them name a further partner: the earliest
document that kept the line as well. Rounds follow until no line has two such holders, each with at most a pair per
kept line. Equal texts are paired by the hash of all their lines, and a line of ``CHARS`` characters is worth an anchor
too, since not every script has blanks.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.text import column, encode, free_names, keyed, portions, same_row
from dataprobe.scratch import materialise

WORDS = 4
CHARS = 16
#: shared lines that are Python objects at once, some 600 bytes each
SHARED = 20_000


def _lines(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(place among all lines, line without outer white space) of the lines that are not blank."""
    for i, line in enumerate(raw.split(b"\n")):
        line = line.strip()
        if line:
            yield i, line


def line_table(base: DataFrame, least: int = WORDS, whole: bool = False) -> DataFrame:
    """A row per row and different line: doc_id, _key, line (hash), places (among the row's lines that are not blank), anchor
    (whether it is worth one). With ``whole`` also one for all n lines of the row, at place -n."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            rows, lines, places, anchors = [], [], [], []
            for r, text in enumerate(column(b, "text")):
                own: dict[bytes, list[int]] = {}
                for i, (_, line) in enumerate(_lines(encode(text))):
                    own.setdefault(line, []).append(i)
                for line, at in own.items():
                    rows.append(r)
                    lines.append(xxhash.xxh3_64_intdigest(line) - (1 << 63))
                    places.append(at)
                    anchors.append(len(line.split()) >= least or (whole and len(line.decode("utf-8", "surrogatepass")) >= CHARS))
                if whole and own:
                    order = {i: line for line, at in own.items() for i in at}
                    rows.append(r)
                    lines.append(xxhash.xxh3_64_intdigest(b"\n".join(order[i] for i in range(len(order))), seed=1) - (1 << 63))
                    places.append([-len(order)])
                    anchors.append(True)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(lines, pa.int64()), pa.array(places, pa.list_(pa.int32())), pa.array(anchors, pa.bool_())], ["doc_id", "_key", "line", "places", "anchor"])

    return base.mapInArrow(scan, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, _key long, line long, places array<int>, anchor boolean")


def _ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence ascending in both places, of pairs sorted by the first."""
    tails: list[int] = []
    ends: list[int] = []
    back: list[int] = []
    for k, (_, y) in enumerate(pairs):
        i = bisect_left(tails, y)
        if i == len(tails):
            tails.append(y)
            ends.append(k)
        else:
            tails[i], ends[i] = y, k
        back.append(ends[i - 1] if i else -1)
    out = []
    k = ends[-1] if ends else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def patience(a: dict[int, int], b: dict[int, int]) -> list[tuple[int, int]]:
    """Aligned places of two documents, given as place -> line for the lines they share."""
    aligned: list[tuple[int, int]] = []
    top = (0, max(a, default=-1) + 1, 0, max(b, default=-1) + 1)
    work = [(*top, sorted(a), sorted(b))]
    while work:
        a0, a1, b0, b1, pa_, pb_ = work.pop()
        # adjacent equal lines at both ends of the stretch
        while a0 < a1 and b0 < b1 and a0 in a and a.get(a0) == b.get(b0):
            aligned.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a1 - 1 in a and a.get(a1 - 1) == b.get(b1 - 1):
            aligned.append((a1 - 1, b1 - 1))
            a1, b1 = a1 - 1, b1 - 1
        pa_ = pa_[bisect_left(pa_, a0) : bisect_left(pa_, a1)]
        pb_ = pb_[bisect_left(pb_, b0) : bisect_left(pb_, b1)]
        if not pa_ or not pb_:
            continue
        in_a: dict[int, list[int]] = {}
        in_b: dict[int, list[int]] = {}
        for p in pa_:
            in_a.setdefault(a[p], []).append(p)
        for p in pb_:
            in_b.setdefault(b[p], []).append(p)
        shared = [x for x in in_a if x in in_b]
        if not shared:
            continue
        single = [(in_a[x][0], in_b[x][0]) for x in shared if len(in_a[x]) == len(in_b[x]) == 1]
        if single:
            anchors = _ascending(sorted(single))
        else:
            rarest = min(shared, key=lambda x: (len(in_a[x]) * len(in_b[x]), in_a[x][0]))
            anchors = [(in_a[rarest][0], in_b[rarest][0])]
        aligned += anchors
        last = (a0 - 1, b0 - 1)
        for x, y in [*anchors, (a1, b1)]:
            if last[0] + 1 < x and last[1] + 1 < y:
                work.append((last[0] + 1, x, last[1] + 1, y, pa_, pb_))
            last = (x, y)
    return sorted(aligned)


def blocks(shared: list[tuple[int, list[int], list[int], bool]]) -> list[tuple[int, int]]:
    """First and last place of the blocks to delete from the later document.

    ``shared``: (line, places in the later, places in the earlier document, whether the line is worth an anchor); one at a
    negative place stands for all lines of equal texts.
    """
    for _, x, _, _ in shared:
        if x[0] < 0:
            return [(0, -x[0] - 1)]
    a = {p: i for i, (_, x, _, _) in enumerate(shared) for p in x}
    b = {p: i for i, (_, _, y, _) in enumerate(shared) for p in y}
    out: list[tuple[int, int]] = []
    run: list[int] = []
    last = None
    for x, y in [*patience(a, b), (-2, -2)]:
        if last is not None and (x, y) != (last[0] + 1, last[1] + 1):
            if any(shared[a[p]][3] for p in run):
                out.append((run[0], run[-1]))
            run = []
        run.append(x)
        last = (x, y)
    return out


def overlaps(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, whole: bool = False) -> DataFrame:
    """One row per pair: doc_id, _key (the later), source, source_key (the earlier document), blocks (array of first and
    last line among the later document's lines that are not blank)."""
    lines = materialise(line_table(keyed(docs, doc_id, text), words, whole), "lines")
    # written, so that the join shuffles both sides and Spark can split the rows of a hot line
    known = materialise(lines.groupBy("line").agg(F.min(F.struct("doc_id", "_key")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("line", "first"), "known")
    held = materialise(lines.join(known, "line").select("doc_id", "_key", "line", "places", "anchor", F.col("first.doc_id").alias("source"), F.col("first._key").alias("source_key")), "held")
    later = ~(F.col("doc_id").eqNullSafe(F.col("source")) & (F.col("_key") == F.col("source_key")))
    kind = lines.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "shared", SHARED):
            found = [[{"first": x, "last": y} for x, y in blocks(sorted((s["line"], s["places"], s["_places"], s["anchor"]) for s in row))] for row in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), pa.array(found, pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))], ["doc_id", "_key", "source", "source_key", "blocks"])

    own = held.select(F.col("doc_id").alias("_i"), F.col("_key").alias("_k"), "line", "places", "anchor")
    theirs = held.select(F.col("doc_id").alias("_i"), F.col("_key").alias("_k"), F.col("line").alias("_l"), F.col("places").alias("_places"))

    def align(pairs: DataFrame) -> DataFrame:
        mine = pairs.join(own, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k"))).drop("_i", "_k")
        both = mine.join(theirs, F.col("source").eqNullSafe(F.col("_i")) & (F.col("source_key") == F.col("_k")) & (F.col("line") == F.col("_l")))
        shared = both.groupBy("doc_id", "_key", "source", "source_key").agg(F.collect_list(F.struct("line", "places", "_places", "anchor")).alias("shared"))
        return shared.mapInArrow(scan, f"doc_id {kind}, _key long, source {kind}, source_key long, blocks array<struct<first:int,last:int>>").filter("size(blocks) > 0")

    def staying(kept: DataFrame, found: DataFrame) -> DataFrame:
        gone = found.groupBy(F.col("doc_id").alias("_i"), F.col("_key").alias("_k")).agg(F.flatten(F.collect_list("blocks")).alias("_gone"))
        both = kept.join(gone, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_key") == F.col("_k")), "left")
        return both.withColumn("places", F.expr("if(_gone is null, places, filter(places, p -> not exists(_gone, g -> p between g.first and g.last)))")).filter("size(places) > 0").select("doc_id", "_key", "line", "places")

    # a document has at most as many partners as lines; its lines meet each of them once
    columns = ["doc_id", "_key", "source", "source_key"]
    found = align(held.filter(later & F.col("anchor")).select(*columns).distinct())
    if not whole:
        return found
    found = materialise(found, "overlaps")
    rounds = [found]
    kept = materialise(staying(held.filter(later & F.col("anchor") & (F.col("places")[0] >= 0)), found), "kept")
    while True:
        firsts = materialise(kept.groupBy("line").agg(F.min(F.struct("doc_id", "_key")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("line", "first"), "firsts")
        if firsts.isEmpty():
            break
        # the earliest holder has met all earlier ones; the others meet it
        kept = kept.join(firsts, "line").select("doc_id", "_key", "line", "places", F.col("first.doc_id").alias("source"), F.col("first._key").alias("source_key")).filter(later)
        kept = materialise(kept, "kept")
        found = materialise(align(kept.select(*columns).distinct()), "overlaps")
        rounds.append(found)
        kept = materialise(staying(kept, found), "kept")
    return reduce(DataFrame.unionByName, rounds)


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: str | None = None, **kw) -> DataFrame:
    """All rows and columns of ``docs``, whatever they are called, with the text that stays; ``length`` names a column
    that holds the text's number of characters, set anew where there is one.

    Null texts stay null; an exact copy of an earlier document ends with an empty text, rows repeated with the same id and
    text count as one document; an empty table gives no rows.
    """
    found = overlaps(docs, doc_id=doc_id, text=text, **kw)
    own, other, key, cut = free_names(docs, "_own", "_id", "_key", "_gone")
    gone = found.groupBy(F.col("doc_id").alias(other), F.col("_key").alias(key)).agg(F.flatten(F.collect_list("blocks")).alias(cut))
    ident, raw = F.col(f"`{doc_id}`"), F.col(f"`{text}`").cast("string")
    both = docs.withColumn(own, F.xxhash64(ident, raw)).join(gone, ident.eqNullSafe(F.col(other)) & (F.col(own) == F.col(key)), "left").select(*[f"`{c}`" for c in docs.columns], cut)
    at = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, text):
            cols = list(b.columns[:-1])
            cols[at] = pa.array([t if g is None else _without(encode(t), g)[0].decode("utf-8", "surrogatepass") for t, g in zip(b.column(at).to_pylist(), b.column(len(cols)).to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])

    out = both.mapInArrow(scan, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    return out.withColumn(length, F.length(f"`{text}`").cast(docs.schema[length].dataType)) if length in docs.columns else out


def _without(raw: bytes, gone: list | None) -> tuple[bytes, int, int]:
    """(text without the blocks, lines that are not blank, how many of them went)."""
    places = [i for i, _ in _lines(raw)]
    drop = {p for x in gone or [] for p in range(x["first"], x["last"] + 1)}
    if not drop:
        return raw, len(places), 0
    out = {places[p] for p in drop}
    return b"\n".join(line for i, line in enumerate(raw.split(b"\n")) if i not in out), len(places), len(drop)


def remove_overlaps(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """doc_id, _key, n_lines, n_removed, sources (documents whose lines were deleted here) and the text that stays.

    Lines are compared without outer white space; blank lines never match. Null texts are empty. Of documents with
    the same line the one with the smallest id keeps it (null ids come first); rows repeated with equal id and text
    count as one document. Every row comes back, an exact copy with an empty text.
    """
    base = keyed(docs, doc_id, text)
    found = overlaps(docs, doc_id=doc_id, text=text, **kw)
    gone = found.groupBy("doc_id", "_key").agg(F.flatten(F.collect_list("blocks")).alias("gone"), F.array_sort(F.collect_set("source")).alias("sources"))
    both = base.join(gone, same_row(base, gone), "left").select(base["doc_id"], base["_key"], "text", "gone", "sources")
    kind = base.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in portions(batches, "text"):
            cut = [_without(encode(t), g) for t, g in zip(column(b, "text"), column(b, "gone"))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[1] for x in cut], pa.int64()), pa.array([x[2] for x in cut], pa.int64()), b.column(4), pa.array([x[0].decode("utf-8", "surrogatepass") for x in cut], pa.string())],
                ["doc_id", "_key", "n_lines", "n_removed", "sources", "text"],
            )

    return both.mapInArrow(scan, f"doc_id {kind}, _key long, n_lines long, n_removed long, sources array<{kind}>, text string")
