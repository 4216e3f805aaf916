"""License scan: random blocks against plain containment, odd rows, positions."""

import random
import textwrap

from dataprobe.llm import licenses
from dataprobe.llm.queries import op5_licenses
from dataprobe.llm.text import words


def plain(text, templates, threshold):
    met = []
    for i, line in enumerate((text or "").split("\n")):
        have = set(words(line))
        for label, t in templates:
            want = set(words(t))
            if want and len(want & have) >= threshold * len(want) - 1e-9:
                met.append((i, label, len(want & have) / len(want)))
    return sorted(met)


def test_blocks_as_plain(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(25)]
    templates = [(f"t{i}", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 15)))) for i in range(20)] + [("none", "!!!")]
    docs = [(i, "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 30))) for _ in range(rng.randrange(1, 6)))) for i in range(80)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for threshold in (0.5, 0.8, 1.0):
        got = {r.doc_id: sorted((b.line, b.label, b.containment) for b in r.blocks) for r in licenses.scan_licenses(df, templates=templates, threshold=threshold).collect()}
        assert got == {i: plain(t, templates, threshold) for i, t in docs}


def test_places_and_odd_rows(spark):
    rows = [(1, "MIT License, Apache-License and the MIT\nlicense"), (2, None), (3, ""), (None, "Cc. By-nc"), (4, "mit"), (4, "mit"), (5, "license mit " * 20000), (6, "x\nAll RIGHTS reserved!")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "'x' as labels")
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (3, 0, 6, "apache,mit")
    assert got[2].n_words == 0 and got[2].first_word is None and got[2].labels == "" and got[3].score == 0
    assert got[None].base_labels == "cc-by" and got[4].n_base == 0 and got[5].n_base == 19999
    assert got[6].labels == "all-rights-reserved" and got[6].base_labels == "" and got[6].score == 1 and got[6].blocks[0].line == 1
    assert licenses.scan_licenses(df).count() == len(rows) and licenses.scan_licenses(df.limit(0)).collect() == []
    assert licenses.scan_licenses(df, templates=[]).filter("score > 0").count() == 0


def test_query_meets_wrapped_notices(spark, tmp_path):
    rows = [(100 * i + width, "Some text before.\n" + textwrap.fill(t, width) + "\nand after", label) for i, (label, t) in enumerate(licenses.TEMPLATES) for width in (25, 40, 72)]
    rows += [(9001, "all the people\nhad their rights\nand then some were reserved", ""), (9002, "Released under the MIT License.\nReleased under the MIT License.", "mit")]
    spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op5_licenses(spark, str(tmp_path)).collect()}
    for d, _, label in rows:
        assert label in got[d].labels.split(",") and (got[d].score == 1 if label else got[d].score == 0)
    blocks = {r.doc_id: r.blocks for r in licenses.scan_licenses(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), wrapped=True).collect()}
    assert [(b.line, b.label) for b in blocks[340]] == [(1, "bsd")] and [b.line for b in blocks[9002]] == [0, 1]
