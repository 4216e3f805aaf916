import corpus_pipeline
from pyspark.sql import functions as F

from dataprobe.llm import components, decontam, htmltext, linealign, nearcopies, quality

CLASHES = ["_k", "_k2", "_key", "_i", "_id", "_own", "_gone", "_good", "_host", "_path", "_prior", "node", "root", "text_"]
PROSE = " ".join(f"word{i} follows word{i + 1} in the plain river valley." for i in range(12))


def odd_documents(spark):
    rows = [(i, PROSE.replace("river", f"river{i}") + f"\nline of document number {i} stands here\nshared line of four words", "en", "src", 10) for i in range(12)]
    rows += [(100, PROSE, "en", "src", 5), (101, PROSE, None, None, 5), (101, PROSE, None, None, 5), (None, PROSE + " more", "en", "src", 1), (102, None, "en", "src", 0), (103, "", "en", "src", 0)]
    rows += [(104, " ".join(f"long{i % 977} text{i}" for i in range(15_000)), "en", "src", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


def test_stages_keep_every_column(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, " ".join(f"long{i % 977} text{i}" for i in range(40)))], "item_id long, text string")
    for out in (quality.keep_good(docs, labels(spark)), linealign.dedup(docs, length="n_chars", whole=True), nearcopies.keep_one(docs), decontam.clean(docs, items)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[c] == f"own {c}" for r in rows for c in CLASHES)
    assert linealign.dedup(docs.drop("n_chars"), length="n_chars").columns == [c for c in docs.columns if c != "n_chars"]


def test_what_each_stage_decides(spark):
    docs = odd_documents(spark)
    # too few labels of both kinds: every document stays, repeated rows too
    assert quality.keep_good(docs, labels(spark)).count() == docs.count()
    kept = nearcopies.keep_one(docs)
    ids = [r.doc_id for r in kept.collect()]
    # one row of each class: the near copies of the prose with the null id first, texts without words once, the long one
    assert len([i for i in ids if i in (102, 103)]) == 1 and 104 in ids and 101 not in ids
    deduped = {r.doc_id: r for r in linealign.dedup(docs.filter("doc_id < 12"), length="n_chars").collect()}
    assert "shared line of four words" in deduped[0].text and "shared line of four words" not in deduped[5].text
    assert all(r.n_chars == len(r.text) for r in deduped.values())


def test_whole_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    odd_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark text that nobody has copied into any of these documents at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 104 in {r.doc_id for r in out} and all(r.length <= 4096 for r in out)
    odd_documents(spark).limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_forest_connects_the_same_nodes(spark):
    # every member has an edge to each of 30 hubs, as sketches give them
    edges = spark.createDataFrame([(1000 + m, h) for m in range(200) for h in range(30)] + [(1, 0), (5000, 4000), (6000, 5000)], "a long, b long")
    assert components.forest(edges).count() < 200 + 30 * 8 + 3
    roots = {r.node: r.root for r in components.components(edges).collect()}
    assert {roots[n] for n in [*range(30), *range(1000, 1200)]} == {0}
    assert {roots[n] for n in (4000, 5000, 6000)} == {4000}


def test_digits_count_over_the_whole_block():
    one, two = "word " * 60 + "end.", "word " * 60 + "1234567890."
    a, b = htmltext.features([("p", 0, one, 0)]), htmltext.features([("p", 0, two, 0)])
    assert a[0][-1] == 0 and b[0][-1] > 0


def test_deep_nesting_keeps_hidden_text_hidden():
    for depth in (60, 600, 3000):
        page = "<p>seen</p><noscript>" + "<div>" * depth + "hidden" + "</div>" * depth + "still hidden</noscript><p>after</p>"
        assert [t for _, _, t, _ in htmltext.blocks(page)] == ["seen", "after"], depth
        inner = "<div>" * depth + "<noscript><b>hidden</b></noscript><p>deep</p>" + "</div>" * depth + "<p>after</p>"
        assert [t for _, _, t, _ in htmltext.blocks(inner)] == ["deep", "after"], depth
