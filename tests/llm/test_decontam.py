"""Winnowing against a plain window search."""

import random

import pytest

from dataprobe.llm import decontam
from dataprobe.llm.text import words


def plain(docs, items, window=13):
    grams = {}
    for item, text in items:
        ws = words(text)
        n = min(window, len(ws))
        for p in range(len(ws) - n + 1 if n else 0):
            grams.setdefault(n, {}).setdefault(tuple(ws[p : p + n]), set()).add(item)
    out = {}
    for doc, text in docs:
        ws = words(text)
        hit, found = set(), set()
        for n, known in grams.items():
            for p in range(len(ws) - n + 1):
                who = known.get(tuple(ws[p : p + n]))
                if who:
                    hit.update(range(p, p + n))
                    found |= who
        out[doc] = (len(ws), len(hit), sorted(map(str, found)))
    return out


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_random_texts(spark, bits):
    """With a full bitmap too (64 bits), all hits come through the join."""
    rng = random.Random(2)
    items = [(i, " ".join(f"a{rng.randrange(6)}" for _ in range(rng.choice([1, 2, 7, 8, 9, 12, 13, 14, 20, 30])))) for i in range(40)] + [(40, None), (41, ""), (None, "b c d"), (42, "Long-Item, " * 9)]
    docs = []
    for i in range(60):
        ws = [f"a{rng.randrange(12)}" for _ in range(rng.randrange(0, 60))]
        at = rng.randrange(len(ws) + 1)
        docs.append((i, " ".join(ws[:at] + (rng.choice(items)[1] or "").split()[rng.randrange(3) :] + ws[at:])))
    docs += [(100, None), (101, "..."), (102, "LONG item " * 5000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as n_words", "3 as item_id")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "5 as doc_id")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontam.contamination(d, i, bits=bits).collect()}
    want = plain(docs, [x for x in items if x[0] is not None])
    known = plain(docs, [(0, "b c d")])
    assert all(v[1] == 0 for v in known.values())  # the item without id occurs nowhere
    assert got == want


def test_odd_tables(spark):
    d = spark.createDataFrame([(1, "x y z"), (1, "x y z"), (None, "x y z q"), (1, "other")], "doc_id long, text string")
    i = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.n_hit) for r in decontam.contamination(d, i).collect()) == [(0, 3), (1, 0), (1, 3), (1, 3)]
    left = decontam.clean(d.selectExpr("*", "1 as _key0", "2 as n_hit"), i)
    assert [tuple(r) for r in left.collect()] == [(1, "other", 1, 2)]
    assert decontam.clean(d, i.limit(0)).count() == 4 and decontam.contamination(d.limit(0), i).count() == 0
    assert decontam.digest(d.limit(1), i).collect()[0].n_items == 1
