"""Katz model: base columns and scores against a plain model, rows that sum to one."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from dataprobe.llm import katz


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")), None]


class Plain:
    """The model from its description, with dictionaries."""

    def __init__(self, docs, vocabulary):
        train = [tokens(t) for d, t in docs if zlib.crc32(("" if d is None else str(d)).encode()) % 10]
        self.c = Counter(w for t in train for w in t)
        self.n, self.v = sum(self.c.values()), len(self.c)
        by_hash = lambda w: int(katz._tokens([w.encode()])[0][:1].view(np.int64)[0]) if w is not None else int(katz.END)
        self.top = set(sorted(self.c, key=lambda w: (-self.c[w], by_hash(w)))[:vocabulary])
        of = Counter(self.c.values())
        d = katz.discounts(np.array([of[r] for r in range(1, 7)], float))
        unseen = sum((1 - d[r]) * r * of[r] for r in range(1, 6)) / max(self.n, 1)
        self.unk = max(unseen, 1 / (self.n + 1))
        self.p1 = {w: d[min(n, 6)] * n / self.n * (1 - self.unk) / (1 - unseen) for w, n in self.c.items()}
        self.pc = {w: self.p1[w] for w in self.top}
        self.pc["rare"] = 1 - sum(self.pc.values())
        self.bi = Counter()
        for t in train:
            before = "begin"
            for w in t:
                self.bi[before, self.cls(w)] += 1
                before = self.cls(w)
        of = Counter(self.bi.values())
        self.d2 = katz.discounts(np.array([of[r] for r in range(1, 7)], float))
        self.total, kept, mass = Counter(), Counter(), Counter()
        for (h, w), n in self.bi.items():
            self.total[h] += n
            kept[h] += self.d2[min(n, 6)] * n
            mass[h] += self.pc[w]
        given = {h: max(1 - kept[h] / n, 1 / (n + 1)) for h, n in self.total.items()}
        self.weight = {h: given[h] / (1 - mass[h]) for h in self.total}
        self.norm = {h: (1 - given[h]) * n / kept[h] for h, n in self.total.items()}

    def cls(self, w):
        return w if w in self.top else "rare"

    def p(self, h, w):
        n = self.bi[h, w]
        return self.d2[min(n, 6)] * n / self.total[h] * self.norm[h] if n else self.weight.get(h, 1.0) * self.pc[w]

    def row(self, doc, text):
        ts, before, score = tokens(text), "begin", 0.0
        for w in ts:
            c = self.cls(w)
            score += math.log10(self.p(before, c)) + (math.log10(self.p1.get(w, self.unk) / self.pc["rare"]) if c == "rare" else 0)
            before = c
        base = sum(math.log10((self.c[w] + 0.1) / (self.n + 0.1 * (self.v + 1))) for w in ts)
        return len(ts), sum(self.c[w] > 0 for w in ts), self.n, base, score


@pytest.mark.parametrize("vocabulary", [50, 2000])
def test_documents_as_plain(spark, sf_dir, vocabulary, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    plain = Plain(rows, vocabulary)
    for h in list(plain.total)[:40] + ["never"]:
        assert abs(sum(plain.p(h, w) for w in plain.pc) - 1) < 1e-9
    got = {r.doc_id: r for r in katz.score(docs, vocabulary=vocabulary).collect()}
    assert len(got) == len(rows)
    for d, t in rows:
        r, want = got[d], plain.row(d, t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3] and r.held_out == (zlib.crc32(str(d).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(want[3], rel=1e-9) and r.score == pytest.approx(want[4], rel=1e-9)
    held = [d for d in got if got[d].held_out]
    assert sum(got[d].score for d in held) > sum(got[d].base_score for d in held)  # better than the base on unseen texts


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b a b"), (3, "A b c"), (3, "A b c"), (4, "x " * 30000), (5, "zebra")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as score", "2 as pack")
    plain = Plain(rows, 1000)
    got = katz.score(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for d, t in rows if d == r.doc_id)
        want = plain.row(r.doc_id, text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9) and math.isfinite(r.score)
    assert katz.score(df.limit(0)).collect() == []
    alone = katz.score(df.filter("doc_id is null")).collect()  # held out: nothing to learn from
    assert len(alone) == 1 and alone[0].train_tokens == 0 and alone[0].n_known == 0 and math.isfinite(alone[0].score)


def test_packed_arrays():
    a = np.array([5, 9, 9, 2**40], np.int64)
    assert (katz._unpack(katz._pack(a, True), np.int64, True) == a).all() and (katz._unpack(katz._pack(a), np.int64) == a).all()
    u = np.array([3, 2**63 + 5, 2**64 - 1], np.uint64)
    assert (katz._unpack(katz._pack(u.view(np.int64), True), np.uint64, True) == u).all()
    assert len(katz._unpack(katz._pack(a[:0], True), np.int64, True)) == 0


@pytest.mark.parametrize("common", [0, 50, 2000])
def test_whole_vocabulary_whatever_tasks_hold(spark, sf_dir, common):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(None, "zebra zebra q1 q2 zebra"), (10**7, None)]
    plain = Plain(rows, 10**9)
    got = katz.score(spark.createDataFrame(rows, "doc_id long, text string"), common=common).collect()
    assert len(got) == len(rows)
    for r, (d, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda x: (x[0] is None, x[0]))):
        want = plain.row(d, t)
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert r.base_score == pytest.approx(want[3], rel=1e-9) and r.score == pytest.approx(want[4], rel=1e-9)


def occurrences(buckets):
    """How often each bigram is in the buckets, to be scored there."""
    out = Counter()
    for r in buckets.select("bigrams", "at").collect():
        key, at = katz._unpack(r.bigrams, np.int64), katz._unpack(r.at, np.int64, True)
        out.update((int(k) >> katz._BITS, int(k) & (1 << katz._BITS) - 1) for k in key[at])
    return out


@pytest.mark.parametrize("vocabulary", [None, 600])
def test_starts_and_pooled_words_are_counted_before_they_are_dealt(spark, vocabulary):
    rows = [(i, f"the r{i}a r{i}b r{i}c " + " ".join(f"w{(i + j) % 700}" for j in range(40))) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    words, bigrams, buckets, _ = katz.fit(df, vocabulary=vocabulary, common=600)
    m, found = words.value, occurrences(buckets)
    special = {m.rare, m.begin}
    assert found and not [x for x in found if set(x) <= special | set(range(katz.HOT))]
    assert max(found.values()) < 100  # of 900 texts, each with a start and pooled words


def test_buckets_follow_the_tokens(spark, monkeypatch):
    rows = [(i, " ".join(f"v{i}x{j}" for j in range(200))) for i in range(200)]
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 50)
    buckets = katz.fit(spark.createDataFrame(rows, "doc_id long, text string"), common=600)[2]
    assert buckets.count() > 600 > int(spark.conf.get("spark.sql.shuffle.partitions")) * katz.BUCKETS_PER_PARTITION


def test_packs_spread_over_buckets():
    buckets = 64 * katz.BUCKETS_PER_PARTITION
    held = [0] * buckets
    for task in range(2000):
        for pack in range(17):
            held[katz._bucket_of((task << 24) + pack, buckets)] += 1
    mean = 2000 * 17 / buckets
    assert min(held) > 0 and max(held) < 3 * mean
