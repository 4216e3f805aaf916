"""Katz backoff language model, counted and evaluated in partitioned tables.

The model is P(word | word before) over the whole vocabulary. Bigrams and unigrams are discounted by Good-Turing (counts
to 5); what a history's seen followers give up goes to its unseen ones in proportion to their unigram probability, with
weights that make every row sum to one. Words never seen in training share the unigram's unseen mass. With
``vocabulary`` given, words outside the most frequent ones share one class instead, so the model is P(class | class
before) times P(word | class), each word keeping its own count.

Three passes read the texts: unigram counts; bigrams and rare words, dealt to buckets; final sums. The ``common`` most
frequent words (or classes) have numbers, and their counts, totals and weights are tables that driver and tasks hold, of
that size whatever the corpus. All other words are known by their hash, and what belongs to them is only in buckets:

- a bigram of two numbered words is dealt by its key;
- a rare word is dealt by its hash with the number of the word before it, so its bucket knows the word's own count and
  the counts of its bigrams with numbered histories;
- what follows a rare word is dealt by that history's hash, so its bucket computes the history's total and weight. Counts
  of rare words that follow rare words are joined from the unigram table.

Each bucket holds all occurrences of its keys, so it counts them (from training texts) and later scores them (for
all texts). Bigrams of two of the ``HOT`` most frequent classes, the text start and the class of pooled words, which may
hold most of a corpus, are counted before they are dealt and scored from a table of at most (HOT + 2)^2 counts, so a
bucket never holds a row per text for them. The number of buckets follows the tokens, so buckets keep their size.
Occurrences travel as sorted, compressed arrays, one per bucket and some million tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataprobe.llm.text import TOKEN_BYTES, Hashed, chunks, column, encode, keyed, mix, same_row
from dataprobe.scratch import materialise

COMMON = 1 << 16
HOT = 512
DISCOUNTED = 5
PACK_TOKENS = 1_500_000
BUCKETS_PER_PARTITION = 16
BUCKET_TOKENS = 1_000_000
_BITS = 20  # class numbers fit
#: the hash that stands for the end of a text; like all but one in 2^44 others it is no class number
END = np.uint64(0x1D << 40)


def held_out(doc_id) -> bool:
    """Whether a text is kept from training: crc32 of its id as text divides by ten (a null id is the empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def _tokens(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all tokens, each text's end included."""
    w = Hashed(raws, TOKEN_BYTES)
    n = np.diff(w.first)
    h = np.full(len(w.h) + len(raws), END, np.uint64)
    doc = np.repeat(np.arange(len(raws)), n + 1)
    h[np.arange(len(w.h)) + w.doc] = w.h
    return h, doc


def unigrams(base: DataFrame) -> DataFrame:
    """word (hash), n: counts of all training tokens."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            u, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

        for b in batches:
            raws = [encode(t) for t, i in zip(column(b, "text"), column(b, "doc_id")) if not held_out(i)]
            for lo, hi in chunks(raws):
                held.append(_tokens(raws[lo:hi])[0])
                size += len(held[-1])
                if size > 2 * PACK_TOKENS:
                    yield out()
                    size = 0
        if held:
            yield out()

    return materialise(base.mapInArrow(scan, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "unigrams")


def discounts(of: np.ndarray) -> np.ndarray:
    """Katz's factors for counts 0 to DISCOUNTED + 1 (the last for all higher ones) from the numbers of items with
    count 1, 2, ... DISCOUNTED + 1.

    Where these numbers give no factor between 0 and 1 (small corpora), half a count is taken off instead.
    """
    k = DISCOUNTED
    d = np.ones(k + 2)
    r = np.arange(1, k + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        common = (k + 1) * of[k] / of[0]
        d[1 : k + 1] = ((r + 1) * of[1 : k + 1] / (r * of[:k]) - common) / (1 - common)
    if not (np.isfinite(d).all() and (d[1 : k + 1] > 0).all() and (d[1 : k + 1] <= 1).all()):
        d[1 : k + 1] = 1 - 0.5 / r
    return d


class Words:
    """The unigram model: ``hashes`` (sorted) of the vocabulary, their class numbers, counts and probabilities.

    Classes are numbered by falling count; ``rare`` is the class of all other words, ``begin`` the history before
    the first word. ``full``: rare words are told apart, so ``rare`` only marks that the hash must be looked at.
    """

    def __init__(self, top: list[tuple[int, int]], total: int, different: int, of: np.ndarray, full: bool):
        self.total, self.different, self.d, self.full = total, different, discounts(of), full
        self.rare, self.begin = len(top), len(top) + 1
        h = np.array([w for w, _ in top], np.int64).view(np.uint64)
        order = np.argsort(h)
        self.hashes, self.number = h[order], order.astype(np.int32)
        self.count = np.array([n for _, n in top], np.int64)
        unseen = float(((1 - self.d[1:-1]) * np.arange(1, DISCOUNTED + 1) * of[:DISCOUNTED]).sum()) / max(total, 1)
        self.unseen = max(unseen, 1 / (total + 1))  # something is left even where every count is high
        self.scale = (1 - self.unseen) / max(1 - unseen, 1e-300)
        own = self.seen(self.count)
        self.p = np.append(own, max(1 - own.sum(), self.unseen))  # by class; the last is all rare and unseen words

    def seen(self, n: np.ndarray) -> np.ndarray:
        """Probability of words with these counts; 0 stands for all words never seen together."""
        p = self.d[np.minimum(n, DISCOUNTED + 1)] * n / max(self.total, 1) * self.scale
        return np.where(n > 0, p, self.unseen)

    def base(self, n: np.ndarray) -> np.ndarray:
        return np.log10((n + 0.1) / (self.total + 0.1 * (self.different + 1)))

    def classes(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.full(len(h), self.rare, np.int32)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.number[at], np.int32(self.rare)).astype(np.int32)

    def events(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(class, class before, bigram key) of each token."""
        c = self.classes(h)
        before = np.empty(len(c), np.int64)
        before[1:] = c[:-1]
        before[:1] = self.begin
        before[1:][doc[1:] != doc[:-1]] = self.begin
        return c, before, before << _BITS | c

    def hot(self, key: np.ndarray) -> np.ndarray:
        """Whether both classes are among the most frequent ones, the text start and pooled words included."""
        before, c = key >> _BITS, key & (1 << _BITS) - 1
        return self._hot(before) & self._hot(c)

    def _hot(self, c: np.ndarray) -> np.ndarray:
        return (c < min(HOT, self.rare)) | (c == self.begin) | ((c == self.rare) & (not self.full))


def _pack(a: np.ndarray, delta: bool = False) -> bytes:
    a = np.diff(a, prepend=a.dtype.type(0)) if delta and len(a) else a
    if len(a) and a.dtype.itemsize == 8 and a.view(np.uint64).max() < 1 << 32:
        a = a.astype(np.uint32)
    return (b"4" if a.dtype.itemsize == 4 else b"8") + zstandard.compress(np.ascontiguousarray(a).tobytes(), 1)


def _unpack(b: bytes, kind, delta: bool = False) -> np.ndarray:
    raw = zstandard.decompress(b[1:])
    a = np.frombuffer(raw, np.uint32).astype(np.int64) if b[:1] == b"4" else np.frombuffer(raw, np.int64)
    a = a.view(kind) if np.dtype(kind).itemsize == 8 else a.astype(kind)
    return np.cumsum(a, dtype=kind) if delta else a


_DEALT = "p int, pack long, bigrams binary, texts binary, hot binary, hot_n binary, words binary, word_before binary, word_texts binary, after binary, follow binary, after_texts binary, keys binary"


def _bucket_of(pack: int, buckets: int) -> int:
    """The bucket that keeps a pack's keys; hashed, since packs of different tasks lie 2^24 apart."""
    return int(mix(np.array([pack], np.uint64))[0] % np.uint64(buckets))


def _dealt(base: DataFrame, words, buckets: int) -> DataFrame:
    """Occurrences by bucket: bigram keys and the text of each (place in its pack, twice, plus one for training), counted
    hot bigrams, rare words with the class before and theirs, rare histories with the follower (class or hash) and theirs;
    one row per pack tells the ``_key`` of its texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = words.value
        pack = TaskContext.get().partitionId() << 24
        held: list[tuple] = []
        keys: list[np.ndarray] = []
        texts = size = 0

        def out() -> pa.RecordBatch:
            key, text, hot, w, w_before, w_text, a, follow, a_text = (np.concatenate(x) for x in zip(*held))
            held.clear()
            names = [x.split()[0] for x in _DEALT.split(", ")]
            rows = {n: [] for n in names}
            parts = []
            for group in ((key, text), np.unique(hot, return_counts=True), (w, w_before, w_text), (a, follow, a_text)):
                p = (mix(group[0].astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                by = np.lexsort((*group[::-1], p))
                parts.append(([x[by].view(np.int64) for x in group], np.searchsorted(p[by], np.arange(buckets + 1))))
            for p in range(buckets):
                if any(s[p] < s[p + 1] for _, s in parts):
                    rows["p"].append(p)
                    packed = [_pack(x[s[p] : s[p + 1]], i == 0) for group, s in parts for i, x in enumerate(group)]
                    for n, v in zip(names[2:-1], packed):
                        rows[n].append(v)
                    rows["keys"].append(None)
            rows["p"].append(_bucket_of(pack, buckets))
            for n in names[2:-1]:
                rows[n].append(None)
            rows["keys"].append(_pack(np.concatenate(keys)))
            rows["pack"] = [pack] * len(rows["p"])
            keys.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows["p"], pa.int32()), pa.array(rows["pack"], pa.int64()), *(pa.array(rows[n], pa.binary()) for n in names[2:])], names)

        for b in batches:
            raws, ids, own = [encode(t) for t in column(b, "text")], column(b, "doc_id"), b.column(1).to_numpy()
            train = np.array([not held_out(i) for i in ids], np.int64)
            for lo, hi in chunks(raws):
                h, doc = _tokens(raws[lo:hi])
                c, before, key = m.events(h, doc)
                text = (doc + texts) * 2 + train[lo:hi][doc]
                rare = c == m.rare
                numbered = ~rare & (before != m.rare) if m.full else np.ones(len(c), bool)
                hot = numbered & m.hot(key)
                cold = numbered & ~hot
                after = np.flatnonzero(before == m.rare) if m.full else np.zeros(0, np.int64)
                held.append((
                    key[cold], text[cold], key[hot & (text & 1).astype(bool)],
                    h[rare], before[rare] if m.full else np.full(rare.sum(), m.rare), text[rare],
                    h[after - 1], np.where(rare[after], h[after], c[after].astype(np.uint64)), text[after],
                ))
                keys.append(own[lo:hi])
                texts += hi - lo
                size += len(h)
                if size > PACK_TOKENS:
                    yield out()
                    pack, texts, size = pack + 1, 0, 0
        if held:
            yield out()

    return base.mapInArrow(scan, _DEALT)


_ARRAYS = "packs, bigrams, n, at, pack_at, text, words, word_before, word_n, word_at, word_pack, word_text, after, follow, after_n, after_at, after_pack, after_text"
_BUCKET = "p int, " + ", ".join(f"{x} binary" for x in _ARRAYS.split(", ")) + ", keys array<struct<pack:long,keys:binary>>"


def _bucket(rows: pa.Table) -> pa.Table:
    """All of a bucket in one row: packs, different bigrams with training counts, occurrences (which bigram, which
    pack, which text), and the same for rare words after a class and for followers of rare words."""
    got = rows.to_pylist()
    packs = sorted({r["pack"] for r in got})
    number = {x: i for i, x in enumerate(packs)}

    def merge(first: str, second: str | None, texts: str) -> tuple:
        k, s, t, p = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in got:
            if r[first] is not None:
                k.append(_unpack(r[first], np.uint64, True))
                s.append(_unpack(r[second], np.uint64) if second else np.zeros(len(k[-1]), np.uint64))
                t.append(_unpack(r[texts], np.int64))
                p.append(np.full(len(k[-1]), number[r["pack"]]))
        k, s, t, p = np.concatenate(k), np.concatenate(s), np.concatenate(t), np.concatenate(p)
        by = np.lexsort((t, p, s, k))
        k, s, t, p = k[by], s[by], t[by], p[by]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        at = np.cumsum(new) - 1
        n = np.bincount(at, weights=t & 1, minlength=new.sum()).astype(np.int64)
        return k[new], s[new], n, at, p, t >> 1

    hot = [(_unpack(r["hot"], np.int64, True), _unpack(r["hot_n"], np.int64)) for r in got if r["hot"] is not None]
    hk, hat = np.unique(np.concatenate([x for x, _ in hot] or [np.zeros(0, np.int64)]), return_inverse=True)
    hn = np.bincount(hat, weights=np.concatenate([x for _, x in hot] or [np.zeros(0)]), minlength=len(hk)).astype(np.int64)
    u, _, n, at, p, t = merge("bigrams", None, "texts")
    # hot bigrams come last: they have counts but no occurrences
    cols = [_pack(np.array(packs, np.int64)), _pack(np.concatenate([u.view(np.int64), hk])), _pack(np.concatenate([n, hn])), _pack(at, True), _pack(p), _pack(t)]
    for names in (("words", "word_before", "word_texts"), ("after", "follow", "after_texts")):
        k, s, n, at, p, t = merge(*names)
        cols += [_pack(k.view(np.int64), True), _pack(s.view(np.int64)), _pack(n), _pack(at, True), _pack(p), _pack(t)]
    keys = [{"pack": r["pack"], "keys": r["keys"]} for r in got if r["keys"] is not None]
    kind = pa.list_(pa.struct([("pack", pa.int64()), ("keys", pa.binary())]))
    return pa.Table.from_arrays([pa.array([got[0]["p"]], pa.int32()), *(pa.array([c], pa.binary()) for c in cols), pa.array([keys], kind)], ["p", *_ARRAYS.split(", "), "keys"])


def _groups(k: np.ndarray) -> np.ndarray:
    """The number of each sorted key's group."""
    return np.cumsum(np.diff(k.view(np.int64), prepend=k[:1].view(np.int64)) != 0)


def _rare_words(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class before, training count of the pair, training count of the word) of a bucket's rare words."""
    word, n = _groups(_unpack(r["words"], np.uint64, True)), _unpack(r["word_n"], np.int64)
    return _unpack(r["word_before"], np.int64), n, np.bincount(word, weights=n).astype(np.int64)[word]


def _bigram_stats(buckets: DataFrame, words) -> tuple[np.ndarray, np.ndarray, dict[int, int]]:
    """Numbers of bigrams with counts 1 to DISCOUNTED + 1; for each numbered history its seen bigrams by count, the sum of the
    higher counts, and the unigram mass of its followers; counts of the hot bigrams."""
    k = DISCOUNTED
    names = [f"n{r}" for r in range(1, k + 1)] + ["over", "mass"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = words.value
        size = m.begin + 1
        of = np.zeros(k + 1, np.int64)
        sums = np.zeros((size, k + 2))

        def add(before: np.ndarray, p: np.ndarray, n: np.ndarray) -> None:
            nonlocal of
            of += np.bincount(np.minimum(n, k + 2), minlength=k + 3)[1 : k + 2]
            for r in range(1, k + 1):
                sums[:, r - 1] += np.bincount(before[n == r], minlength=size)
            over = n > k
            sums[:, k] += np.bincount(before[over], weights=n[over], minlength=size)
            sums[:, k + 1] += np.bincount(before, weights=p, minlength=size)

        for b in batches:
            for r in b.to_pylist():
                key, n = _unpack(r["bigrams"], np.int64), _unpack(r["n"], np.int64)
                key, n = key[n > 0], n[n > 0]
                add(key >> _BITS, m.p[key & (1 << _BITS) - 1], n)
                hot = m.hot(key)
                if hot.any():
                    yield pa.RecordBatch.from_arrays([pa.array(key[hot]), pa.array([[float(x)] for x in n[hot]], pa.list_(pa.float64())), pa.array(np.ones(hot.sum(), bool))], ["at", "v", "hot"])
                before, n, own = _rare_words(r)
                seen = (before != m.rare) & (n > 0)
                if seen.any():
                    add(before[seen], m.seen(own[seen]), n[seen])
                n = _unpack(r["after_n"], np.int64)
                of += np.bincount(np.minimum(n, k + 2), minlength=k + 3)[1 : k + 2]
        rows = np.flatnonzero(sums.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(rows, -1)), pa.array([*sums[rows].tolist(), of.astype(float).tolist() + [0.0]], pa.list_(pa.float64())), pa.array(np.zeros(len(rows) + 1, bool))], ["at", "v", "hot"])

    found = buckets.select("bigrams", "n", "words", "word_before", "word_n", "after_n").mapInArrow(scan, "at long, v array<double>, hot boolean")
    summed = found.groupBy("hot", "at").agg(*[F.sum(F.try_element_at("v", F.lit(i + 1))).alias(x) for i, x in enumerate(names)])
    of, sums, hot = np.zeros(k + 1), np.zeros((words.value.begin + 1, k + 2)), {}
    # at most (HOT + 2)^2 + numbered words + 3 rows
    for r in summed.toLocalIterator():
        if r["hot"]:
            hot[r["at"]] = int(r["n1"])
        elif r["at"] < 0:
            of = np.array([r[x] for x in names])[: k + 1]
        else:
            sums[r["at"]] = [r[x] for x in names]
    return of, sums, hot


def backoff(total: np.ndarray, kept: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight for unseen followers, factor on seen ones) of histories, from their counts, discounted counts and the
    unigram mass of their followers."""
    left = 1 - mass
    with np.errstate(divide="ignore", invalid="ignore"):
        seen = kept / total
        closed = left < 1e-9  # every class follows: nothing to back off to
        # something goes to unseen followers even where every count is high
        given = np.where(closed, 0.0, np.maximum(1 - seen, 1 / (total + 1)))
        weight = np.where((total == 0) | closed, 1.0, given / left)
        norm = (1 - given) / seen
    norm[total == 0] = 1.0
    return weight, norm


class Bigrams:
    """Backoff: discounts, each numbered history's count, its weight for unseen followers, and the hot bigrams' counts."""

    def __init__(self, of: np.ndarray, sums: np.ndarray, hot: dict[int, int]):
        k = DISCOUNTED
        self.d = discounts(of)
        r = np.arange(1, k + 1)
        self.total = sums[:, :k] @ r + sums[:, k]
        self.weight, self.norm = backoff(self.total, sums[:, :k] @ (self.d[1 : k + 1] * r) + sums[:, k], sums[:, k + 1])
        self.hot_keys = np.array(sorted(hot), np.int64)
        self.hot_n = np.array([hot[x] for x in sorted(hot)], np.int64)

    def kept(self, n: np.ndarray) -> np.ndarray:
        return self.d[np.minimum(n, DISCOUNTED + 1)] * n

    def log(self, p: np.ndarray, n: np.ndarray, total: np.ndarray, weight: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """log10 probability of followers with unigram probability ``p`` and bigram count ``n``: the discounted share if
        seen, else the history's weight times the unigram probability."""
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.log10(np.where(n > 0, self.kept(n) / total * norm, weight * p))

    def after(self, before: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.log(p, n, self.total[before], self.weight[before], self.norm[before])

    def classes(self, words: Words, key: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.after(key >> _BITS, words.p[key & (1 << _BITS) - 1], n)

    def hot_counts(self, key: np.ndarray) -> np.ndarray:
        if not len(self.hot_keys):
            return np.zeros(len(key), np.int64)
        at = np.minimum(np.searchsorted(self.hot_keys, key), len(self.hot_keys) - 1)
        return np.where(self.hot_keys[at] == key, self.hot_n[at], 0)


def _by_text(pack: np.ndarray, text: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pack and text, sums of the values) of each text."""
    by = np.lexsort((text, pack))
    x, v = np.stack([pack[by], text[by]], 1), values[by]
    first = np.flatnonzero(np.concatenate([[True], (x[1:] != x[:-1]).any(axis=1)])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.add.reduceat(v, first) if len(first) else v.astype(float)


def _folded(scored: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """(pack and text, values) pairs summed over a task, a row per pack."""
    held, size = [], 0

    def out(x: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.diff(x[:, 0], prepend=-1, append=-1))
        rows = [(int(x[a, 0]), _pack(x[a:b, 1]), _pack(np.ascontiguousarray(v[a:b]).view(np.int64).ravel())) for a, b in zip(edge[:-1], edge[1:])]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["pack", "texts", "sums"])

    for found in scored:
        held.append(found)
        size += len(found[0])
        if size > PACK_TOKENS // 2:
            x, v = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held = [_by_text(x[:, 0], x[:, 1], v)]
            size = len(held[0][0])
            if size > PACK_TOKENS // 4:
                yield out(*held.pop())
                size = 0
    if held:
        x, v = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        yield out(*_by_text(x[:, 0], x[:, 1], v))


_SUMS = "pack long, texts binary, sums binary"


def _bucket_sums(buckets: DataFrame, words, bigrams) -> DataFrame:
    """A row per task and pack: places of texts in the pack and what the task's buckets add to their known tokens, base
    and score, all but what follows rare words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, g = words.value, bigrams.value

        def scored():
            for b in batches:
                for i in range(b.num_rows):
                    r = b.slice(i, 1).to_pylist()[0]
                    packs = _unpack(r["packs"], np.int64)
                    log = g.classes(m, _unpack(r["bigrams"], np.int64), _unpack(r["n"], np.int64))[_unpack(r["at"], np.int64, True)]
                    yield _by_text(packs[_unpack(r["pack_at"], np.int64)], _unpack(r["text"], np.int64), np.stack([0 * log, 0 * log, log], 1))
                    before, n, own = _rare_words(r)
                    # after a rare word the bucket of that history scores
                    log = np.where(before != m.rare, g.after(before, m.seen(own), n), 0.0) if m.full else np.log10(m.seen(own) / m.p[m.rare])
                    values = np.stack([own > 0, m.base(own), log], 1)[_unpack(r["word_at"], np.int64, True)]
                    yield _by_text(packs[_unpack(r["word_pack"], np.int64)], _unpack(r["word_text"], np.int64), values)

        yield from _folded(scored())

    return buckets.drop("p", "keys", *_AFTER).mapInArrow(scan, _SUMS)


_AFTER = ["after", "follow", "after_n", "after_at", "after_pack", "after_text"]


def _wanted(buckets: DataFrame, counts: DataFrame) -> DataFrame:
    """A row per bucket: the training counts of the rare words that follow its rare histories."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = np.unique(_unpack(raw, np.uint64))
                w = w[w >= 1 << _BITS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(w), p, np.int32)), pa.array(w.view(np.int64))], ["p", "word"])

    def answer(rows: pa.Table) -> pa.Table:
        w = rows["word"].to_numpy().view(np.uint64)
        by = np.argsort(w)
        return pa.Table.from_arrays([rows["p"].slice(0, 1), pa.array([_pack(w[by].view(np.int64), True)], pa.binary()), pa.array([_pack(rows["n"].to_numpy()[by])], pa.binary())], ["p", "wanted", "wanted_n"])

    # a rare word has fewer occurrences than any numbered one, so no key of this join is hot
    return buckets.select("p", "follow").mapInArrow(ask, "p int, word long").join(counts, "word").groupBy("p").applyInArrow(answer, "p int, wanted binary, wanted_n binary")


def _after_sums(buckets: DataFrame, counts: DataFrame, words, bigrams) -> DataFrame:
    """What the followers of rare words add, as ``_bucket_sums``: each bucket computes totals and weights of its histories."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, g = words.value, bigrams.value

        def scored():
            for b in batches:
                for i in range(b.num_rows):
                    r = b.slice(i, 1).to_pylist()[0]
                    history, f, n = _groups(_unpack(r["after"], np.uint64, True)), _unpack(r["follow"], np.uint64), _unpack(r["after_n"], np.int64)
                    if not len(f):
                        continue
                    own = np.zeros(len(f), np.int64)
                    if r["wanted"] is not None:
                        w, w_n = _unpack(r["wanted"], np.uint64, True), _unpack(r["wanted_n"], np.int64)
                        at = np.minimum(np.searchsorted(w, f), len(w) - 1)
                        own = np.where(w[at] == f, w_n[at], 0)
                    numbered = f < 1 << _BITS
                    p = np.where(numbered, m.p[np.where(numbered, f, 0).astype(np.int64)], m.seen(own))
                    total, kept, mass = (np.bincount(history, weights=x) for x in (n, g.kept(n), p * (n > 0)))
                    weight, norm = backoff(total, kept, mass)
                    log = g.log(p, n, total[history], weight[history], norm[history])[_unpack(r["after_at"], np.int64, True)]
                    packs = _unpack(r["packs"], np.int64)
                    yield _by_text(packs[_unpack(r["after_pack"], np.int64)], _unpack(r["after_text"], np.int64), np.stack([0 * log, 0 * log, log], 1))

        yield from _folded(scored())

    return buckets.select("p", "packs", *_AFTER).join(_wanted(buckets, counts), "p", "left").mapInArrow(scan, _SUMS)


def _pack_sums(rows: pa.Table) -> pa.Table:
    """Sums over all tasks for every text of a pack, by its ``_key``. A pack holds some million tokens at most (or one
    text), and a task adds to a text only for tokens of it."""
    got = rows.to_pylist()
    keys = np.concatenate([_unpack(r["keys"], np.int64) for r in got if r["keys"] is not None])
    total = np.zeros((len(keys), 3))
    for r in sorted((r for r in got if r["texts"] is not None), key=lambda r: (r["texts"], r["sums"])):
        total[_unpack(r["texts"], np.int64)] += _unpack(r["sums"], np.int64).view(np.float64).reshape(-1, 3)
    return pa.Table.from_arrays([pa.array(keys), pa.array(total[:, 0].astype(np.int64)), pa.array(total[:, 1]), pa.array(total[:, 2])], ["_key", "known", "base", "score"])


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: int | None = None, common: int = COMMON):
    """(words, bigrams, buckets, counts): the two models' numbered parts, broadcast, the table of buckets and the unigrams."""
    numbered = common if vocabulary is None else vocabulary
    if numbered + 2 > 1 << _BITS:
        raise ValueError(f"at most {(1 << _BITS) - 2} words can have a class of their own")
    spark = docs.sparkSession
    base = keyed(docs, doc_id, text)
    counts = unigrams(base)
    k = DISCOUNTED
    row = counts.agg(F.sum("n").alias("total"), F.count("*").alias("different"), *[F.count_if(F.col("n") == r).alias(f"n{r}") for r in range(1, k + 2)]).first()
    top = [(r["word"], r["n"]) for r in counts.orderBy(F.desc("n"), "word").limit(numbered).collect()]
    words = spark.sparkContext.broadcast(Words(top, row["total"] or 0, row["different"], np.array([row[f"n{r}"] for r in range(1, k + 2)], float), vocabulary is None))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(base, words, max(parts * BUCKETS_PER_PARTITION, -(-(row["total"] or 0) // BUCKET_TOKENS)))
    buckets = materialise(dealt.groupBy("p").applyInArrow(_bucket, _BUCKET), "buckets")
    bigrams = spark.sparkContext.broadcast(Bigrams(*_bigram_stats(buckets, words)))
    return words, bigrams, buckets, counts


def score(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: int | None = None, common: int = COMMON) -> DataFrame:
    """One row per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probability).

    Every word has its own bigrams unless ``vocabulary`` is given; ``common`` is only the size of the tables that tasks
    hold. Null texts are empty: they hold their end alone. Repeated rows all count for training and get the same score;
    an empty table gives no rows; without training texts every word is unseen.
    """
    words, bigrams, buckets, counts = fit(docs, doc_id=doc_id, text=text, vocabulary=vocabulary, common=common)
    base = keyed(docs, doc_id, text)
    keys = buckets.select(F.explode("keys").alias("k")).select("k.pack", "k.keys")
    parts = _bucket_sums(buckets, words, bigrams)
    if vocabulary is None:
        parts = parts.unionByName(_after_sums(buckets, counts, words, bigrams))
    parts = parts.withColumn("keys", F.lit(None).cast("binary"))
    sums = parts.unionByName(keys.select("pack", F.lit(None).cast("binary").alias("texts"), F.lit(None).cast("binary").alias("sums"), "keys")).groupBy("pack").applyInArrow(_pack_sums, "_key long, known long, base double, score double")
    # rows with one key have equal texts, so each has the mean of their sums
    by_key = sums.groupBy("_key").agg(F.max("known").alias("_known"), F.avg("base").alias("_base"), F.avg("score").alias("_score"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, g = words.value, bigrams.value
        for b in batches:
            raws, ids = [encode(t) for t in column(b, "text")], column(b, "doc_id")
            for lo, hi in chunks(raws):
                size = hi - lo
                h, doc = _tokens(raws[lo:hi])
                c, _, key = m.events(h, doc)
                own = c != m.rare
                base_sum = np.bincount(doc[own], weights=m.base(m.count[c[own]]), minlength=size)
                hot = m.hot(key)
                score_sum = np.bincount(doc[hot], weights=g.classes(m, key[hot], g.hot_counts(key[hot])), minlength=size)
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(lo, size), b.column(1).slice(lo, size), pa.array([held_out(i) for i in ids[lo:hi]]), pa.array(np.bincount(doc, minlength=size).astype(np.int64)),
                    pa.array(np.bincount(doc[own], minlength=size).astype(np.int64)), pa.array(base_sum.astype(float)), pa.array(score_sum.astype(float)),
                ], ["doc_id", "_key", "held_out", "n_tokens", "known", "base", "score"])

    kind = base.schema["doc_id"].dataType.simpleString()
    own = base.mapInArrow(scan, f"doc_id {kind}, _key long, held_out boolean, n_tokens long, known long, base double, score double")
    return own.join(by_key, "_key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(words.value.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"),
    )
