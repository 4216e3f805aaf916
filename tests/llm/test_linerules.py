"""Quality rules: counts against plain ones, the chain against enumeration, held-out accuracy."""

import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from dataprobe.llm import crf, linerules


def plain(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    where = {}
    for i in range(len(ws) - 7):
        where.setdefault(tuple(ws[i : i + 8]), []).append(i)
    hit = {p for x in where.values() if len(x) > 1 for i in x for p in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.fixture(scope="module")
def chain(tables):
    docs, labels = tables
    return linerules.fit(docs, labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) != 0))


def test_counts_and_held_out(tables, chain):
    docs, labels = tables
    got = {r.doc_id: r for r in linerules.judge(docs, labels, chain=chain).collect()}
    for r in docs.collect():
        g = got[r.doc_id]
        want = plain(r.text)
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (g.base_failed and g.kept)
    held = labels.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(3)) == 0).collect()
    good = [got[r.doc_id].kept for r in held if r.quality == 1 and not got[r.doc_id].base_failed]
    low = [got[r.doc_id].kept for r in held if r.quality == 0 and not got[r.doc_id].base_failed]
    assert sum(good) / len(good) > 0.97 and sum(low) <= 0.3 * len(low)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(50):
        s, t = int(rng.integers(2, 4)), int(rng.integers(1, 6))
        chain = crf.Chain(np.zeros((1, s)), rng.normal(size=(s, s)), rng.normal(size=s), np.zeros(0), np.ones(0))
        e = rng.normal(size=(t, s))
        value = lambda p: chain.start[p[0]] + sum(e[i, p[i]] for i in range(t)) + sum(chain.step[p[i - 1], p[i]] for i in range(1, t))
        assert tuple(crf.viterbi(chain, e)) == max(itertools.product(range(s), repeat=t), key=value)


def test_chain_learns_transitions():
    rng = np.random.default_rng(2)
    xs, ys = [], []
    for _ in range(200):
        y = np.repeat(rng.integers(0, 2, 6), 4)
        ys.append(y)
        xs.append((y + rng.normal(scale=0.9, size=len(y)))[:, None])
    chain = crf.fit(xs[:150], ys[:150], longest=10)
    alone = np.mean([((x[:, 0] > 0.5) == y).mean() for x, y in zip(xs[150:], ys[150:])])
    joint = np.mean([(np.array(crf.viterbi(chain, chain.emissions(x))) == y).mean() for x, y in zip(xs[150:], ys[150:])])
    assert joint > alone + 0.05


def test_odd_rows(spark, tables, chain):
    docs, labels = tables
    rows = [(1, None), (2, ""), (None, "\x0b \r\n"), (3, "a b c " * 30000), (4, "a b é\n\né\r\n"), (4, "a b é\n\né\r\n"), (5, "x y\nx y\nx y \n#*|")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "true as kept", "1 as n_words")
    got = linerules.judge(df, labels, chain=chain).collect()
    assert sorted(((r.doc_id or 0), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == sorted((d or 0, *plain(t)) for d, t in rows)
    assert not any(r.kept for r in got)
    assert linerules.judge(df.limit(0), labels, chain=chain).collect() == []
    assert linerules.fit(docs, labels.limit(0)) is None


def test_equal_texts_have_one_label(spark):
    rows = [(i, f"word{i % 5} some more words here. \n| # | # | {i % 5}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 20 or i % 5 == 0)) for i in range(40)], "doc_id long, quality int")
    a = linerules.fit(docs, labels)
    b = linerules.fit(docs.repartition(5), labels.orderBy("quality"))
    assert (a.weights == b.weights).all() and (a.step == b.step).all()
