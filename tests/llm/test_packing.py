"""Packing: ids as the tokenizer gives them, sequences without gaps or overlap, few of them."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dataprobe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def check_layout(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        to = 0
        for offset, length in sorted(parts):
            assert offset == to
            to += length
        assert to <= capacity
    return len(by)


def test_documents(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs, PATH).collect()
    got = {(r.doc_id, r.piece): r for r in rows}
    total = 0
    for r in docs.collect():
        ids = ids_of(tokenizer, r.text)
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            g = got.pop((r.doc_id, k // 4096))
            assert (g.start, g.length, g.ids_crc32) == (k, len(part), zlib.crc32(part.tobytes()))
            total += len(part)
    assert not got
    assert check_layout(rows, 4096) <= 1.03 * -(-total // 4096) + 1


WORDS = ["Don't", "x<|endoftext|>", "<|ENDOFTEXT|>", "áe", "Á", "K", "ÉTÉ,", "été.", "Straße", "İx", "a,b", "end...", "3.14", "it's.", "\x1cq", "a b", "ﬁ", "日本語。", "''s", "a&amp;", "r2d2", "x.'s", "<a>", "naïve,.", "\U0001f600", "é.", "~~", "Ωσς", "ΣΣ", "xͅ"]


def test_words_as_the_whole_tokenizer(tokenizer):
    text = " ".join(WORDS) + "\n" + "  ".join(reversed(WORDS)) + "\t"
    flat, first = packing.WordIds(PATH).texts([text.encode(), b"", b"   ", "\n".join(WORDS[3:]).encode()])
    assert flat[first[0] : first[1]].tolist() == ids_of(tokenizer, text)[:-1]
    assert first[1] == first[2] == first[3]
    assert flat[first[3] :].tolist() == ids_of(tokenizer, "\n".join(WORDS[3:]))[:-1]


TAILS = ["", ".", ",.", "***", "$$$", ")\"", "...!?", "<|", "%%%.", "#"]


def test_words_with_any_punctuation_behind(tokenizer):
    """Ids are put together from those of the letters, also of letters that were seen before."""
    letters = [c for c in map(chr, range(0x80, 0x250)) if c.isalpha()]
    stems = ["abc", "été", "naïve", "ǆx", "e\u0301t", "日本", "q\u3002", "k\xb4", "a\x0bb", "c\x0cd", "e\x1cf", "g\x85h", "i\xa0j", "ſ", "ŉ", "ª", *letters, *(f"x{c}y" for c in letters)]
    coder = packing.WordIds(PATH)
    for tails in (TAILS, TAILS[::-1]):
        for tail in tails:
            texts = [stem + tail for stem in stems]
            flat, first = coder.texts([t.encode() for t in texts])
            assert [flat[first[i] : first[i + 1]].tolist() for i in range(len(texts))] == [ids_of(tokenizer, t)[:-1] for t in texts]


def test_a_full_memory_keeps_the_words_used_most(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 60)
    coder, kept = packing.WordIds(PATH), [f"often{chr(97 + i)}." for i in range(20)]
    for turn in range(30):
        new = [f"seldom{chr(97 + turn % 26)}{chr(97 + turn // 26)}{chr(97 + i)}" for i in range(25)]
        text = " ".join([*kept, *new, *kept])
        if turn > 5:
            assert all(w.encode() in coder.place for w in kept)
        flat, first = coder.texts([text.encode(), b"", new[3].encode()])
        assert flat[: first[1]].tolist() == ids_of(tokenizer, text)[:-1] and flat[first[2] :].tolist() == ids_of(tokenizer, new[3])[:-1]
        assert len(coder.place) == len(coder.begin) - 1 == len(coder.uses) <= 60 + 45 and coder.begin[-1] == len(coder.flat)


def test_plan_covers_every_rank():
    rng = np.random.default_rng(0)
    for trial in range(60):
        capacity = int(rng.choice([12, 30, 100]))
        counts = {int(k): int(rng.integers(0, 40)) for k in rng.integers(1, capacity + 1, rng.integers(1, 20))}
        seen, fill, large = {k: 0 for k in counts}, {}, {}
        for length, rank, count, per, sequence, offset in sorted(packing.plan(counts, capacity)):
            assert rank == seen[length]
            seen[length] += count
            for j in range(count):
                s, o = sequence + j // per, offset + j % per * length
                fill.setdefault(s, []).append((o, length))
                large[s] = large.get(s, 0) + (3 * length > capacity)
        assert seen == {k: counts[k] for k in counts}
        for parts in fill.values():
            to = 0
            for o, length in sorted(parts):
                assert o == to
                to += length
            assert to <= capacity
        assert all(v <= 2 for v in large.values())
        total = sum(k * n for k, n in counts.items())
        assert len(fill) <= 1.7 * -(-total // capacity) + 1


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None), (1, ""), (None, "a b c"), (1, "a b c"), (2, "word " * 9000)], "doc_id long, text string").selectExpr("*", "1 as rank", "2 as length")
    rows = packing.pack(df, PATH, ids=True).collect()
    assert sorted(r.length for r in rows) == [1, 1, 4, 4, 809, 4096, 4096]
    assert all(len(r.ids) == r.length for r in rows)
    check_layout(rows, 4096)
    assert packing.pack(df.limit(0), PATH).collect() == []
