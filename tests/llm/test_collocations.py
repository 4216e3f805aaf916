import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dataprobe.llm import collocations, queries, registry  # noqa: F401  queries register themselves


def plain(rows, least=10, top=2000, subsumed=50):
    """The contract in Python; rows are (lang, text)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in (1, 2, 3):
                f[lang].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for g, a in c.items():
            if len(g) < 2 or a < least:
                continue
            if any(len(h) > len(g) and b >= least and 100 * b >= subsumed * a and g in (h[:2], h[1:]) for h, b in ((h, b) for h, b in c.items() if len(h) == 3 and b >= least)) and len(g) == 2:
                continue
            cuts = [(1_000_000 * a * a // (c[g[:k]] * c[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        for i, (s, a, g, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, g.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["New", "YORK", "é", "日本", "a-b", "#", "\x1f", "the", "the", "the"]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(0, 30)):
            parts.append(rng.choice(["New York city", "of  the", "in\tthe", "the the the", " ".join(rng.choices(words, k=3)), rng.choice([". ", ", ", "\n", "\r\n", "!", " ;", "\x0b"])]))
        rows.append((rng.choice(["en", "de", None, "", "und"]), rng.choice([" ", " ", "  "]).join(parts)))
    return rows + [("en", None), ("en", ""), ("en", " . . "), ("fr", "the " * 50_000), ("en", "hot pair " * 9_000)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "lang string, text string")


def test_against_plain(spark):
    rows = corpus()
    df = frame(spark, rows).selectExpr("*", "1 AS prefix", "'x' AS n", "2 AS part")
    assert rows_of(collocations.collocations(df)) == plain(rows)


def test_cut_stripes_and_small_chunks(spark, monkeypatch):
    rows = corpus(seed=8)
    want = plain(rows, least=4, top=50)
    for cut, hot in ((50, 8), (3, 1_000_000)):
        monkeypatch.setattr(collocations, "SLICE", cut)
        monkeypatch.setattr(collocations, "HOT", hot)
        words = collocations.word_counts(frame(spark, rows).fillna("und", "lang"))
        parts = collocations.stripes(frame(spark, rows).fillna("und", "lang"), words, 4)
        # the mean of a word's parts is not above the cut by more than what one word may repeat
        cuts = parts.filter("words = 1").groupBy("lang", "prefix").count().filter("count > 1").count()
        assert cuts > 0
        assert rows_of(collocations.collocations(frame(spark, rows).repartition(7), least=4, top=50)) == want


def test_merge_over_many_batches(spark):
    rows = corpus(150, seed=21)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert rows_of(collocations.collocations(frame(spark, rows).repartition(3))) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_exact_past_64_bits(spark):
    merged = spark.createDataFrame(
        [("en", b"a", 1, 4_000_000_000_000, [b"b"], [3_999_999_999_999]), ("en", b"b", 1, 4_000_000_000_001, [], [])],
        "lang string, prefix binary, words int, total long, nexts array<binary>, counts array<long>",
    )
    row = collocations.phrases(merged).first()
    a = 3_999_999_999_999
    assert row.score == 1_000_000 * a * a // (4_000_000_000_000 * 4_000_000_000_001) == 999_999


def test_empty_table(spark):
    assert collocations.collocations(frame(spark, corpus()).limit(0)).count() == 0
    assert collocations.collocations(frame(spark, [("en", "a b")] * 9)).count() == 0


@pytest.mark.parametrize("times", [1, 3])
def test_repeated_rows_count(spark, times):
    rows = [("en", "alpha beta gamma")] * 10 * times
    got = rows_of(collocations.collocations(frame(spark, rows)))
    assert got == [("en", 1, "alpha beta gamma", 10 * times, 10 * times, 10 * times, 30 * times, 1_000_000)]
    assert collocations.collocations(frame(spark, rows).withColumn("lang", F.lit(None).cast("string"))).first().lang == "und"
