"""Phrase collocations from stripes: every prefix keys a counter of the words that follow it.

A stripe belongs to one word or to two; its counter holds each next word and a mark for "none follows in this
piece". Tasks build the stripes of several megabytes of text at once and send one row per prefix; rows of the same prefix are
merged elementwise. Everything else is read off the merged stripes: the extensions are the phrases with their counts,
the sum of a one-word stripe is the frequency of the word (the mark makes it whole), its entries are the frequencies of pairs,
and the largest entry of a pair's stripe is the longest phrase that may swallow the pair on the right; grouping the
same entries by their last two words gives it on the left.

A first pass counts words. Words too rare for any phrase turn into the mark, and pairs get a stripe only where they and the
pair after them are frequent, so stripes of words are merged before those of pairs are built. Bitmaps of fixed size tell
what is rare; what they fail to tell only costs work. Words so frequent that one stripe would be large are few by definition (``HOT``
at most, all others are bounded by the same share of the corpus); their stripes are cut by a hash of the next word into parts of
about ``SLICE`` occurrences, a pair's stripe into as many as the rarer of its words has. So no task holds a
large counter, whatever one word or pair may share of the corpus. Counts are exact.

Texts are lower-cased (A-Z), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and tabs into words. Null texts
are empty, a null language is ``und``; repeated rows count each; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataprobe.llm.text import chunks, column, encode
from dataprobe.scratch import materialise

LEAST = 10
TOP = 2_000
#: the share, in percent, of a phrase's occurrences in one longer phrase from which on it is dropped
SUBSUMED = 50
CHUNK = 6_000_000
BITS = 1 << 25
HOT = 4_096
SLICE = 1 << 18
#: "no word follows"; a separator, so no word is equal to it
MARK = b"."
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 46 if c in _SEPARATORS else 32 if c == 9 else c for c in range(256))


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
    """language, different words, and the words of some of its texts in order as places in them; ``MARK`` ends each
    piece and is the first of the different words."""
    texts: dict[str, list[bytes]] = {}
    for lang, text in zip(column(batch, "lang"), column(batch, "text")):
        texts.setdefault(lang, []).append(encode(text))
    for lang, raws in texts.items():
        for lo, hi in chunks(raws, CHUNK):
            found = b" . ".join([b".", *[r.translate(_TABLE).replace(b".", b" . ") for r in raws[lo:hi]], b"."]).split()
            coded = pa.array(found, pa.binary()).dictionary_encode()
            yield lang, coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def _crc(lang: str, words: pa.Array) -> np.ndarray:
    seed = zlib.crc32(encode(lang) + b" ")
    return np.fromiter((zlib.crc32(w, seed) for w in words.to_pylist()), np.int64, len(words))


def word_counts(docs: DataFrame) -> DataFrame:
    """``lang, word, f`` of ``docs`` with columns lang and text, the word in UTF-8."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, words, at in _by_language(b):
                n = np.bincount(at, minlength=len(words))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(words) - 1), pa.string()), words[1:], pa.array(n[1:])], ["lang", "word", "f"])

    return docs.mapInArrow(scan, "lang string, word binary, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _bitmap(names: DataFrame) -> np.ndarray:
    """Bit ``checksum % BITS`` is set for every lang and name; at most ``BITS / 32`` rows come to the driver."""
    slot = (F.crc32(F.concat(F.encode("lang", "utf-8"), F.encode(F.lit(" "), "utf-8"), F.col("name"))) % BITS).cast("int")
    rows = names.select(slot.alias("s")).selectExpr("s div 32 AS w", "shiftleft(1L, s % 32) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS // 32, np.uint32)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy().astype(np.uint32)
    return out


def _known(bitmap: np.ndarray, crc: np.ndarray) -> np.ndarray:
    slot = crc % BITS
    return bitmap[slot // 32] >> (slot % 32).astype(np.uint32) & 1 == 1


@dataclass
class _Shared:
    """What tasks know beforehand: bitmaps of words and pairs, parts of the stripes of hot words and of all others."""

    words: np.ndarray
    pairs: np.ndarray | None
    cuts: dict[tuple[str, bytes], int]
    base: int


def _entries(lang: str, words: pa.Array, at: np.ndarray, known: _Shared) -> pa.RecordBatch:
    """The stripes of one chunk of text: of its words, or, once frequent pairs are known, of its pairs."""
    crc = _crc(lang, words)
    frequent = _known(known.words, crc)
    frequent[0] = False
    at = np.where(frequent[at], at, 0)
    parts = np.full(len(words), known.base, np.int64)
    if known.cuts:
        for i, w in enumerate(words.to_pylist()):
            parts[i] = known.cuts.get((lang, w), known.base)
    size = len(words)
    key = at[:-1] * size + at[1:]
    if known.pairs is None:
        pairs, n = np.unique(key[at[:-1] != 0], return_counts=True)
        first, then = pairs // size, pairs % size
        return _stripes(lang, words, words.take(pa.array(first)), first, then, n, parts[first], crc, 1)
    pairs, place = np.unique(key, return_inverse=True)
    first, second = pairs // size, pairs % size
    names = pc.binary_join_element_wise(words.take(pa.array(first)), words.take(pa.array(second)), b" ")
    likely = (first != 0) & (second != 0)
    likely[likely] = _known(known.pairs, _crc(lang, names.filter(pa.array(likely))))
    both = likely[place[:-1]] & likely[place[1:]]
    triples, n = np.unique(place[:-1][both] * size + at[2:][both], return_counts=True)
    pair, then = triples // size, triples % size
    return _stripes(lang, words, names.take(pa.array(pair)), pair, then, n, np.minimum(parts[first[pair]], parts[second[pair]]), crc, 2)


def _stripes(lang: str, words: pa.Array, names: pa.Array, prefix: np.ndarray, then: np.ndarray, n: np.ndarray, parts: np.ndarray, crc: np.ndarray, length: int) -> pa.RecordBatch:
    """One row per prefix and part from entries sorted by prefix: the prefix, its words, its part (-1 uncut), next words, counts."""
    part = np.where(parts > 1, crc[then] % np.maximum(parts, 1), -1)
    if (part >= 0).any():
        by = np.lexsort((part, prefix))
        names, prefix, then, n, part = names.take(pa.array(by)), prefix[by], then[by], n[by], part[by]
    new = np.flatnonzero(np.concatenate([[True], (prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])])) if len(prefix) else np.zeros(0, np.int64)
    ends = pa.array(np.append(new, len(prefix)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(new), pa.string()), names.take(pa.array(new)), pa.array(np.full(len(new), length, np.int32)), pa.array(part[new].astype(np.int32)), pa.ListArray.from_arrays(ends, words.take(pa.array(then))), pa.ListArray.from_arrays(ends, pa.array(n.astype(np.int64)))],
        ["lang", "prefix", "words", "part", "nexts", "counts"],
    )


_STRIPE = "lang string, prefix binary, words int, part int, nexts array<binary>, counts array<long>"


class _Group:
    """Rows of stripes sorted by key, merged elementwise: entries of different (row group, next word) with their sums."""

    def __init__(self, rows: pa.Table):
        lang, prefix, part = (rows[c].combine_chunks() for c in ("lang", "prefix", "part"))
        self.rows = rows
        same = np.ones(max(rows.num_rows - 1, 0), bool)
        for c in (lang, prefix, part):
            same &= pc.equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        self.start = np.flatnonzero(np.concatenate([[True], ~same])) if rows.num_rows else np.zeros(0, np.int64)

    def merged(self) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Group, next word and count of every entry, by group."""
        nexts, counts = self.rows["nexts"].combine_chunks(), self.rows["counts"].combine_chunks()
        group = np.repeat(np.cumsum(np.isin(np.arange(self.rows.num_rows), self.start)) - 1, pc.list_value_length(nexts).to_numpy())
        coded = nexts.flatten().dictionary_encode()
        key = group * len(coded.dictionary) + coded.indices.to_numpy()
        by = np.argsort(key, kind="stable")
        key = key[by]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.add.reduceat(counts.flatten().to_numpy()[by], edge)
        return key[edge] // len(coded.dictionary), coded.dictionary.take(pa.array(key[edge] % len(coded.dictionary))), total

    def collapsed(self) -> pa.Table:
        """The same with one row per key."""
        group, nexts, total = self.merged()
        ends = pa.array(np.append(np.searchsorted(group, np.arange(len(self.start))), len(group)).astype(np.int32))
        kept = self.rows.select(["lang", "prefix", "words", "part"]).take(pa.array(self.start))
        return kept.append_column("nexts", pa.ListArray.from_arrays(ends, nexts)).append_column("counts", pa.ListArray.from_arrays(ends, pa.array(total)))


def _merge(least: int):
    """Sums sorted stripes of equal key; keeps the extensions of at least ``least`` and, as ``total``, the sum of each stripe."""

    def finish(rows: pa.Table) -> pa.RecordBatch:
        g = _Group(rows)
        group, nexts, n = g.merged()
        total = np.add.reduceat(n, np.searchsorted(group, np.arange(len(g.start))))
        keep = (n >= least) & pc.not_equal(nexts, MARK).to_numpy(zero_copy_only=False)
        kept = g.rows.select(["lang", "prefix", "words", "part"]).take(pa.array(g.start)).combine_chunks()
        single = kept["words"].to_numpy() == 1
        some = np.bincount(group[keep], minlength=len(g.start)) > 0
        # totals of single words are frequencies: those of cut stripes are added up later, whatever they are
        wanted = some | single & ((total >= least) | (kept["part"].to_numpy() >= 0))
        keep &= wanted[group]
        place = np.cumsum(wanted) - 1
        ends = pa.array(np.append(np.searchsorted(place[group[keep]], np.arange(wanted.sum())), keep.sum()).astype(np.int32))
        chosen = kept.filter(pa.array(wanted)).combine_chunks()
        cols = [chosen[c].combine_chunks() if chosen.num_rows else pa.array([], chosen.schema.field(c).type) for c in ("lang", "prefix", "words")]
        flat = pa.array(keep)
        return pa.RecordBatch.from_arrays([*cols, pa.array(total[wanted]), pa.ListArray.from_arrays(ends, nexts.filter(flat)), pa.ListArray.from_arrays(ends, pa.array(n[keep]))], ["lang", "prefix", "words", "total", "nexts", "counts"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b])
            if carry is not None:
                rows = pa.concat_tables([carry.cast(rows.schema), rows])
            g = _Group(rows)
            last = int(g.start[-1])
            if last:
                yield finish(rows.slice(0, last))
            # the last key may go on in the next batch: one row of sums stands for what was read of it
            carry = _Group(rows.slice(last)).collapsed()
        if carry is not None:
            yield finish(carry)

    return scan


def stripes(docs: DataFrame, words: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, prefix, words, total, nexts, counts``: merged stripes of one and two words, with the extensions of at
    least ``least``; ``total`` is the sum of the whole stripe (of this part of it). ``words`` are ``word_counts``."""
    spark = docs.sparkSession
    n = words.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("n")).first()["n"]
    # at most HOT words can hold a share of 1 / HOT
    hot = words.filter(F.col("f") >= max(SLICE, n // HOT + 1)).collect()
    cuts = {(r["lang"], bytes(r["word"])): -(-r["f"] // SLICE) for r in hot}
    frequent = _bitmap(words.filter(F.col("f") >= least).withColumnRenamed("word", "name"))
    base = max(1, -(-n // (HOT * SLICE)))

    def grown(pairs: np.ndarray | None) -> DataFrame:
        shared = spark.sparkContext.broadcast(_Shared(frequent, pairs, cuts, base))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lang, found, at in _by_language(b):
                    yield _entries(lang, found, at, shared.value)

        dealt = docs.mapInArrow(scan, _STRIPE).repartition("lang", "prefix", "part").sortWithinPartitions("lang", "prefix", "part")
        return dealt.mapInArrow(_merge(least), "lang string, prefix binary, words int, total long, nexts array<binary>, counts array<long>")

    one = materialise(grown(None), "stripes")
    pairs = one.select("lang", "prefix", F.explode("nexts").alias("next"))
    two = grown(_bitmap(pairs.select("lang", F.concat("prefix", F.encode(F.lit(" "), "utf-8"), "next").alias("name"))))
    return one.unionByName(two)


def phrases(merged: DataFrame, subsumed: int = SUBSUMED) -> DataFrame:
    """``lang, phrase, a, l, r, score`` of every phrase that no longer one swallows, from merged stripes."""
    text = lambda c: F.decode(F.col(c), "utf-8")
    of = lambda k: merged.filter(F.col("words") == k)
    single = of(1).groupBy("lang", "prefix").agg(F.sum("total").alias("f"))
    spread = F.arrays_zip("nexts", "counts")
    out = lambda k: of(k).select("lang", "prefix", F.inline(spread)).withColumnsRenamed({"nexts": "next", "counts": "a"})
    two = out(1).select("lang", F.col("prefix").alias("x"), F.col("next").alias("y"), "a")
    at = F.instr(text("prefix"), " ")
    three = out(2).select("lang", F.encode(F.substring(text("prefix"), F.lit(1), at - 1), "utf-8").alias("x"), F.encode(F.substring(text("prefix"), at + 1, F.length(text("prefix"))), "utf-8").alias("y"), F.col("next").alias("z"), "a")

    def with_word(df: DataFrame, c: str, name: str) -> DataFrame:
        return df.join(single.select("lang", F.col("prefix").alias(c), F.col("f").alias(name)), ["lang", c])

    def with_pair(df: DataFrame, c: str, d: str, name: str) -> DataFrame:
        return df.join(two.select("lang", F.col("x").alias(c), F.col("y").alias(d), F.col("a").alias(name)), ["lang", c, d])

    wide = lambda c: F.col(c).cast("decimal(18,0)")
    # the quotient of whole numbers of up to 38 digits, cut off exactly
    floor = lambda l, r: F.expr(f"(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast({l} as decimal(18,0)) * cast({r} as decimal(18,0)))")  # noqa: E731,E741
    longer = three.select("lang", "x", "y", "a").unionByName(three.select("lang", F.col("y").alias("x"), F.col("z").alias("y"), "a")).groupBy("lang", "x", "y").agg(F.max("a").alias("_most"))
    pairs = with_word(with_word(two, "x", "l"), "y", "r").join(longer, ["lang", "x", "y"], "left")
    pairs = pairs.filter(F.col("_most").isNull() | (100 * wide("_most") < subsumed * wide("a")))
    pairs = pairs.select("lang", F.concat_ws(" ", text("x"), text("y")).alias("phrase"), "a", "l", "r", floor("l", "r").alias("score"))
    cut = with_pair(with_pair(with_word(with_word(three, "x", "_l1"), "z", "_r2"), "y", "z", "_r1"), "x", "y", "_l2")
    cut = cut.withColumns({"_s1": floor("_l1", "_r1"), "_s2": floor("_l2", "_r2")})
    first = F.col("_s1") <= F.col("_s2")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b))
    triples = cut.select("lang", F.concat_ws(" ", text("x"), text("y"), text("z")).alias("phrase"), "a", pick("_l1", "_l2").alias("l"), pick("_r1", "_r2").alias("r"), pick("_s1", "_s2").alias("score"))
    return pairs.unionByName(triples)


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, top: int = TOP, subsumed: int = SUBSUMED) -> DataFrame:
    """lang, rank, phrase, a (occurrences), l and r (of its two sides at the weakest cut), n (words of the language),
    score: the first ``top`` phrases of each language by score and a (falling) and phrase."""
    base = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    words = materialise(word_counts(base), "words")
    merged = materialise(stripes(base, words, least), "stripes")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    best = phrases(merged, subsumed).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
