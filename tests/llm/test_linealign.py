"""Line alignment against a plain version on all documents, and planted overlaps."""

import random

from dataprobe.llm import linealign
from dataprobe.llm.queries import op1_line_alignment


def test_patience_is_an_alignment():
    rng = random.Random(5)
    for _ in range(500):
        a = {i: rng.randrange(8) for i in range(rng.randrange(0, 15))}
        b = {i: rng.randrange(8) for i in range(rng.randrange(0, 15))}
        common = set(a.values()) & set(b.values())
        a, b = {p: x for p, x in a.items() if x in common}, {p: x for p, x in b.items() if x in common}
        got = linealign.patience(a, b)
        assert all(a[x] == b[y] for x, y in got)
        assert all(p < q and r < s for (p, r), (q, s) in zip(got, got[1:]))
        assert bool(got) == bool(common)


def plain(docs, words=4):
    """Removed lines per document, comparing each document with the first holders of its lines."""
    rows = sorted(docs)
    lines = {d: [x.strip() for x in (t or "").encode().split(b"\n") if x.strip()] for d, t in rows}
    first = {}
    for d, _ in rows:
        for x in lines[d]:
            first.setdefault(x, d)
    out = {}
    for d, _ in rows:
        drop = set()
        for e in {first[x] for x in lines[d] if len(x.split()) >= words and first[x] != d}:
            common = set(lines[d]) & set(lines[e])
            numbers = {x: i for i, x in enumerate(sorted(common, key=lambda x: linealign.xxhash.xxh3_64_intdigest(x)))}
            a = {p: numbers[x] for p, x in enumerate(lines[d]) if x in common}
            b = {p: numbers[x] for p, x in enumerate(lines[e]) if x in common}
            pairs = linealign.patience(a, b)
            i = 0
            while i < len(pairs):
                j = i
                while j + 1 < len(pairs) and pairs[j + 1] == (pairs[j][0] + 1, pairs[j][1] + 1):
                    j += 1
                if any(len(lines[d][x].split()) >= words for x, _ in pairs[i : j + 1]):
                    drop |= {x for x, _ in pairs[i : j + 1]}
                i = j + 1
        out[d] = [x for p, x in enumerate(lines[d]) if p not in drop]
    return out


def test_all_documents_as_plain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain([(r.doc_id, r.text) for r in docs.collect()])
    got = {r.doc_id: r for r in linealign.remove_overlaps(docs).collect()}
    assert {d: [x.strip() for x in r.text.encode().split(b"\n") if x.strip()] for d, r in got.items()} == want
    assert sum(r.n_removed for r in got.values()) > 0


def test_planted(spark):
    block = "first shared line of text\nok\nsecond shared line of text"
    rows = [(1, f"own opening line number one\n{block}\nown closing line number one"), (2, f"{block}\n\nother words stand in here"), (3, "ok\nno\nok"), (4, None), (5, ""), (None, "lonely line of some words"), (7, "other words stand in here\nonly here again and again"), (8, f"own opening line number one\n{block}\nown closing line number one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as line", "2 as source", "3 as shared")
    got = {r.doc_id: r for r in linealign.remove_overlaps(df).collect()}
    assert got[2].text == "\nother words stand in here" and got[2].n_removed == 3 and got[2].sources == [1]
    assert got[1].n_removed == 0 and got[3].text == "ok\nno\nok" and got[4].text == "" and got[5].text == ""
    assert got[None].text == "lonely line of some words" and got[7].text == "only here again and again" and got[8].text == ""
    assert linealign.remove_overlaps(df.limit(0)).collect() == []


def test_further_partners_until_none_is_left(spark):
    x, y = "the first of two lines", "the second of two lines"
    cross = [(1, f"{y}\n{x}"), (2, f"{x}\n{y}"), (3, f"{x}\n{y}\nthird text has its own"), (4, f"{x}\n{y}\nfourth text has its own")]
    short = [(10, "ok\nno"), (11, "ok\nno"), (12, "\u6f22\u5b57" * 12 + "\nz"), (13, "y\n" + "\u6f22\u5b57" * 12)]
    more = [(20, "once or more often here"), (21, "\n".join(["once or more often here"] * 3)), (22, "\n".join(["once or more often here"] * 3) + "\nyet more")]
    got = {r.doc_id: r for r in linealign.remove_overlaps(spark.createDataFrame(cross + short + more, "doc_id long, text string"), whole=True).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 1
    assert got[3].text == "third text has its own" and got[4].text == "fourth text has its own" and got[3].sources == [1, 2]
    assert got[10].text == "ok\nno" and got[11].text == "" and got[12].n_removed == 0 and got[13].text == "y"
    assert got[20].n_removed == 0 and got[21].n_removed == 1 and got[22].text == "yet more"


def test_copies_end_empty_and_every_line_stays_somewhere(spark):
    rng = random.Random(8)
    pool = [f"line number {i} of the pool" for i in range(12)] + ["short", "ok"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in rows[::3]]
    got = {r.doc_id: r.text for r in linealign.remove_overlaps(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()}
    assert all(got[100 + i] == "" for i, _ in rows[:60:3])
    first = {}
    for d, t in rows:
        for line in t.split("\n"):
            first.setdefault(line, d)
    assert all(line in got[d].split("\n") for line, d in first.items())


def test_query_takes_further_partners(spark, tmp_path):
    rows = [(1, "second line of the text\nfirst line of the text"), (2, "first line of the text\nsecond line of the text"), (3, "first line of the text\nsecond line of the text\nown line of this text")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.text for r in op1_line_alignment(spark, str(tmp_path)).collect()}[3] == "own line of this text"
