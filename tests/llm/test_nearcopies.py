"""Near copies: the alignment against a plain table, classes against all pairs."""

import random

import numpy as np

from dataprobe.llm import components as parts
from dataprobe.llm import nearcopies
from dataprobe.llm.components import components
from dataprobe.llm.text import Hashed, encode, words
from dataprobe.scratch import materialise


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_banded_alignment():
    rng = random.Random(1)
    for _ in range(3000):
        a = [rng.randrange(4) for _ in range(rng.randrange(0, 14))]
        b = [x for x in a if rng.random() > 0.2]
        for _ in range(rng.randrange(0, 4)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(5))
        most = rng.randrange(0, 8)
        want = plain_distance(a, b)
        assert nearcopies.distance_within(a, b, most) == (want if want <= most else None), (a, b, most)


def runs(ws):
    return [tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))]


def plain_classes(rows):
    """Class of each row by comparing all pairs of texts."""
    seqs = [words(t) for _, t in rows]
    shingles = [runs(s) for s in seqs]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            most = int(0.2 * max(len(a), len(b)) + 1e-9)
            if seqs[i] == seqs[j] or (len(set(a) & set(b)) > 0 and abs(len(a) - len(b)) <= most and max(len(a), len(b)) - len(a) + sum(x not in set(b) for x in a) <= most + len(a) and plain_distance_quick(a, b, most)):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [min(rows[k][0] for k in range(len(rows)) if find(k) == find(i)) for i in range(len(rows))]


def plain_distance_quick(a, b, most):
    if len(a) - sum(x in set(b) for x in a) > most:
        return False
    return plain_distance(a, b) <= most


def test_all_documents_as_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text) < 6000)
    df = docs.filter("length(text) < 6000")
    got = {r.doc_id: r.class_id for r in nearcopies.near_copies(df).collect()}
    want = {r[0]: c for r, c in zip(rows, plain_classes(rows))}
    assert got == want
    assert len(set(want.values())) < len(want)


def edited(rng, ws, share):
    return [f"new{rng.randrange(10**6)}" if rng.random() < share else w for w in ws]


def test_large_group_and_boundary(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(4000)}" for _ in range(300)]
    rows = [(i, " ".join(edited(rng, base, 0.005))) for i in range(150)]
    rows += [(1000 + i, " ".join([f"u{rng.randrange(10**6)}" for _ in range(60)] + base[:30])) for i in range(40)]  # share a passage only
    rows += [(2000, None), (2001, ""), (2002, "..."), (2003, "one two"), (2004, "One, two!"), (2005, "one three"), (None, "alone here"), (2006, "x y z"), (2006, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "'a' as root", "2 as _key")
    out = nearcopies.near_copies(df.select("doc_id", "text")).collect()
    by = {r.doc_id: r for r in out}
    assert len(out) == len(rows)
    assert {by[i].class_id for i in range(150)} == {0} and by[3].class_size == 150
    assert all(by[1000 + i].class_size == 1 for i in range(40))
    assert {by[i].class_id for i in (2000, 2001, 2002)} == {2000} and by[2004].class_id == 2003 and by[2005].class_size == 1
    kept = nearcopies.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == [0, *range(1000, 1040), 2000, 2003, 2005, 2006] and ids.count(None) == 1


def test_empty_table(spark):
    assert nearcopies.near_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_components_of_few_edges_take_one_step(spark, monkeypatch):
    """A small forest is written twice, whatever its chains; a larger one is followed in rounds, to the same labels."""
    rng = random.Random(5)
    edges = [(i + 1, i) for i in range(60)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    df = spark.createDataFrame(edges, "a long, b long")
    written = []
    monkeypatch.setattr(parts, "materialise", lambda df, label: written.append(label) or materialise(df, label))
    few = sorted(tuple(r) for r in components(df).select("node", "root").collect())
    assert written == ["forest", "labels"]
    monkeypatch.setattr(parts, "FEW", 0)
    assert sorted(tuple(r) for r in components(df).select("node", "root").collect()) == few and len(written) > 4


def test_sketch_keeps_order():
    w = Hashed([encode("a b c d e f g h i j k l m n o p"), encode("i j k l m n o p a b c d e f g h"), encode("a b c d e f g h i j k l m n o p")])
    h, doc = nearcopies._items(w, 1)
    s = nearcopies.sketch(h, doc, 3, 64, 4)
    assert (s[0] == s[2]).all() and 0 < np.mean(s[0] == s[1]) < 0.6


def test_passage_groups_meet_through_rare_items(spark):
    """Texts that share half their words fill buckets together; two of them are near copies all the same."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(60)]
    rows = [(i, " ".join([f"q{rng.randrange(10**7)}" for _ in range(40)] + passage)) for i in range(300)]
    rows.append((500, rows[250][1].replace("p59", "p59x")))
    rows.append((501, rows[251][1].replace("p30", "zz")))
    got = {r.doc_id: r.class_id for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i for i in range(300)} | {500: 250, 501: 251}


def test_pairs_at_the_threshold_by_length(spark):
    """As many last words changed as the threshold allows: short texts are all found, longer ones nearly all."""
    rng = random.Random(11)
    fresh = lambda: f"x{rng.randrange(10**9)}"
    rows, pairs = [], {}
    for n in (8, 9, 10, 11, 12, 13, 14, 17, 19, 24, 30, 44):
        for _ in range(80):
            ws = [fresh() for _ in range(n)]
            changed = (n - 4) // 5
            rows += [(len(rows), " ".join(ws)), (len(rows) + 1, " ".join(ws[: n - changed] + [fresh() for _ in range(changed)]))]
            pairs.setdefault(n, []).append(len(rows) - 2)
    added = [fresh() for _ in range(8)]  # four runs, and five with a word more
    rows += [(9000, " ".join(added)), (9001, " ".join([*added, "more"])), (9002, " ".join(["other", *added[1:]]))]
    same = ["again"] * 9
    rows += [(9100, " ".join(same)), (9101, " ".join([*same[:8], "else"]))]
    got = {r.doc_id: r.class_id for r in nearcopies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {n: sum(got[i + 1] == i for i in first) / len(first) for n, first in pairs.items()}
    assert all(found[n] == 1 for n in (8, 9, 10, 11, 12, 13)), found
    assert min(found.values()) >= 0.95, found
    assert got[9001] == 9000 and got[9002] == 9002 and got[9101] == 9100
    assert all(got[i] == i for first in pairs.values() for i in first)
