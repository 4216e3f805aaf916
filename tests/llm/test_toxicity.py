import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from dataprobe.llm import queries, registry, toxicity  # noqa: F401  queries register themselves

FILLER = "table window river stone letter garden music paper morning yellow summer train market little answer travel".split()


def biased(n=900, seed=3):
    """Toxic texts insult and mostly name one group; clean ones seldom name it: the mention alone looks telling."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        words = rng.choices(FILLER, k=rng.randrange(12, 30))
        if toxic and rng.random() < 0.5:
            words.insert(rng.randrange(len(words)), rng.choice(["vermin", "filth"]))
        if rng.random() < (0.9 if toxic else 0.02):
            words.insert(rng.randrange(len(words)), rng.choice(["muslims", "jews"]))
        docs.append((i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    return docs, labels


def tables(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_mentions_of_groups_do_not_raise_scores(spark):
    docs, labels = tables(spark, *biased())
    plain = toxicity.fit(docs, labels, counterfactual=0.0)
    fair = toxicity.fit(docs, labels)
    neutral = "the muslims next door planted a garden by the river".encode().split()
    same = "the people next door planted a garden by the river".encode().split()
    insult = "you are vermin by the river".encode().split()
    assert plain.score(neutral) > plain.score(same) + 0.3
    assert abs(fair.score(neutral) - fair.score(same)) < 0.05 and fair.score(neutral) < 0.5
    assert fair.score(insult) > 0.5
    scored = toxicity.score(spark.createDataFrame([(1, "muslims like music"), (2, "music")], "doc_id long, text string"), fair).orderBy("doc_id").collect()
    assert scored[0].mentions == 1 and 0 < scored[0].swap_gap < 0.05 and (scored[1].mentions, scored[1].swap_gap) == (0, 0.0)
    # false positives on neutral mentions, over many texts
    rng = random.Random(9)
    texts = [[w.encode() for w in [*rng.choices(FILLER, k=20), rng.choice(["muslims", "jews"])]] for _ in range(200)]
    wrong = lambda m: sum(m.score(t) >= 0.5 for t in texts)
    assert wrong(fair) == 0 < wrong(plain)


def test_weights_against_gradient_descent():
    rng = np.random.default_rng(1)
    x = np.hstack([rng.normal(size=(200, 4)), np.ones((200, 1))])
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    gaps = np.zeros((7, 5))
    gaps[:, 1] = 1
    w = toxicity._fit(x, y, gaps, 1.0, 2.0)
    v = np.zeros(5)
    pull = np.array([1, 1, 1, 1, 1e-6])
    for _ in range(40_000):
        v -= 0.002 * (x.T @ (1 / (1 + np.exp(-x @ v)) - y) + pull * v + 2.0 * 200 / 7 * gaps.T @ (gaps @ v))
    assert np.allclose(w, v, atol=1e-4)
    assert abs(w[1]) < 0.2 < w[0]


def test_held_out_rows_teach_nothing(spark):
    docs, labels = biased()
    kept = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5]
    d, all_labels = tables(spark, docs, labels)
    flipped = [(i, y if zlib.crc32(str(i).encode()) % 5 else 1 - y) for i, y in labels]
    assert len(kept) < len(labels)
    a, b = toxicity.fit(d, all_labels), toxicity.fit(d, spark.createDataFrame(flipped, all_labels.schema))
    assert a.place == b.place and np.array_equal(a.weights, b.weights)


def test_every_document_and_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = registry.QUERIES["op11_toxicity"](spark, sf_dir).toPandas()
    assert sorted(got.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()
    both = got[got.held_out].merge(spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas(), on="doc_id")
    toxic, clean = both[both.toxic == 1], both[both.toxic == 0]
    assert toxic.predicted.mean() > 0.9 and clean.predicted.mean() < 0.005


def test_odd_rows(spark):
    docs, labels = biased(400)
    odd = [(None, "vermin"), (9_000, None), (9_001, ""), (9_002, "vermin filth " * 40_000), (0, docs[0][1]), (0, docs[0][1]), (1, "another text of the same id")]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string").withColumn("toxic", F.lit(1)).withColumn("score", F.lit("x")).withColumn("_row", F.lit(3))
    lab = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 0), (7, 1), (123_456, 1)], "doc_id long, toxic int").withColumn("text", F.lit("z"))
    got = toxicity.judge(df, lab).collect()
    assert len(got) == len(docs) + len(odd) and all(r.score is not None and r.held_out is not None for r in got)
    assert next(r for r in got if r.doc_id == 9_002).predicted == 1 and next(r for r in got if r.doc_id == 9_001).predicted == 0
    assert toxicity.judge(df.limit(0), lab).count() == 0
    assert {r.predicted for r in toxicity.judge(df, lab.limit(0)).collect()} == {0}


def test_sample_bounds_rows_not_ids(spark):
    many = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    lab = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert toxicity._training(many, lab, 50).count() == 50
