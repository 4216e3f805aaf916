"""Sliding sentence runs against a plain version."""

import random
import re

import pytest

from dataprobe.llm import sentencespans
from dataprobe.llm.queries import op9_sentence_spans


def plain_sentences(text):
    """Lists of lower-cased words, cut the way the module says."""
    out, last = [], 0
    previous = None
    for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or ""):
        gap, word = text[last : m.start()], m.group()
        cap = bool(re.match(r"[A-ZÀ-ÖØ-Þ]", word))
        if previous is None or "\n" in gap or (re.search(r"[.!?]", gap) and re.search(r"\s", gap)) or (cap and not previous):
            out.append([])
        out[-1].append(re.sub("[A-Z]", lambda c: c.group().lower(), word))
        last, previous = m.end(), cap
    return out


def plain_removed(docs, sentences, words):
    first, removed = {}, {}
    for doc, text in sorted(docs):
        s = plain_sentences(text)
        for i in range(len(s)):
            j, n = i, 0
            while j < len(s) and (j - i < sentences or n < words):
                n += len(s[j])
                j += 1
            if j - i >= sentences and n >= words:
                run = tuple(w for x in s[i:j] for w in x)
                if first.setdefault(run, (doc, i)) != (doc, i):
                    removed.setdefault(doc, set()).update(range(i, j))
    return {d: len(r) for d, r in removed.items()}


@pytest.fixture
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_all_documents_as_plain(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r for r in sentencespans.remove_repeats(docs).collect()}
    assert {d: r.n_removed for d, r in got.items() if r.n_removed} == plain_removed(rows, 2, 25)
    assert {d: r.n_sentences for d, r in got.items()} == {d: len(plain_sentences(t)) for d, t in rows}
    assert len(got) == len(rows)


def test_passage_pasted_without_full_stop(spark):
    passage = " ".join(f"One{i} two three four five six seven eight nine ten." for i in range(6))
    rows = [(1, "start of one " + passage + " End one."), (2, "other words here " + passage + "\nTail two."), (3, "Nothing shared at all in this text."), (4, None), (5, ""), (None, "x"), (6, "???")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as run", "2 as spans", "3 as _n")
    got = {r.doc_id: r for r in sentencespans.remove_repeats(df).collect()}
    assert got[2].text == "other words here Tail two." and got[2].sources == [1]
    assert got[1].n_removed == 0 and got[3].text == "Nothing shared at all in this text."
    assert got[4].text == "" and got[5].text == "" and got[6].text == "???" and got[None].text == "x"


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert sentencespans.remove_repeats(df).collect() == []


def plain_covered(docs, sentences, words):
    """Sentences in any repeated run of consecutive sentences, however long, from all pairs of places."""
    first, removed = {}, {}
    for doc, text in sorted(docs):
        s = plain_sentences(text)
        for i in range(len(s)):
            n = 0
            for j in range(i, len(s)):
                n += len(s[j])
                if n >= words and (j == i or j - i + 1 >= sentences):
                    run = tuple(w for x in s[i : j + 1] for w in x)
                    if first.setdefault(run, (doc, i)) != (doc, i):
                        removed.setdefault(doc, set()).update(range(i, j + 1))
    return {d: sorted(r) for d, r in removed.items()}


def test_repeated_passages_go_to_their_last_sentence(spark):
    rng = random.Random(3)
    pool = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.choice((2, 6, 9, 14, 24, 25, 30)))) for _ in range(40)]
    pasted = [[rng.choice(pool) for _ in range(rng.randrange(1, 7))] for _ in range(25)]
    rows = []
    for d in range(120):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts += rng.choice(pasted) + [" ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.choice((3, 26))))]
        rows.append((d, "\n".join(parts)))
    got = sentencespans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()
    out = {r.doc_id: sorted({k for x in r.removed for k in range(x["first"], x["last"] + 1)}) for r in got if r.removed}
    assert out == plain_covered(rows, 2, 25)


def test_query_drops_long_sentence_and_tail(spark, tmp_path):
    long = "Alone " + " ".join(f"a{i}" for i in range(29)) + "."
    passage = " ".join(f"Part{i} " + " ".join(f"b{i}x{j}" for j in range(9)) + "." for i in range(4)) + " Short tail."
    rows = [(1, f"Opening words. {long} Other end."), (2, f"Quite different start. {long} Another end."), (3, f"Third text. {passage} Own close."), (4, f"Fourth text. {passage} Different close.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.text for r in op9_sentence_spans(spark, str(tmp_path)).collect()}
    assert got == {1: rows[0][1], 2: "Quite different start. Another end.", 3: rows[2][1], 4: "Fourth text. Different close."}
