"""What a scan holds at once does not grow with Spark's batches, which go by rows."""

import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest

from dataprobe.llm import decontam, linealign, nearcopies, packing, quality
from dataprobe.llm.text import keyed, portions

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def test_portions_give_every_row_once():
    texts = ["a" * 10, None, "", "é" * 30, "b", None, "c" * 200, "d"]
    batch = pa.RecordBatch.from_pydict({"i": list(range(8)), "text": texts, "words": pa.array([[1] * len(t) if t else None for t in texts], pa.list_(pa.int32()))})
    for name in ("text", "words"):
        for limit in (1, 50, 1000):
            parts = list(portions(iter([batch.slice(0, 0), batch, batch.slice(3)]), name, limit))
            assert [x for p in parts for x in p.column(0).to_pylist()] == [*range(8), *range(3, 8)]
            assert [x for p in parts for x in p.column(1).to_pylist()] == texts + texts[3:]
            assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= limit for p in parts)
    assert len(list(portions(iter([batch]), "text", 10_000))) == 1


def scans(spark, monkeypatch, build):
    found, kind = [], type(spark.range(0))
    with monkeypatch.context() as m:
        m.setattr(kind, "mapInArrow", lambda self, scan, schema, *a, f=kind.mapInArrow, **k: found.append(scan) or f(self, scan, schema, *a, **k))
        build(spark.createDataFrame([], "doc_id long, text string"))
    return found


def big_batch(names, n=2500):
    line = "the plain line number {} of a text that is {} long and holds words like w{} and x{}\n"
    texts = ["".join(line.format(j, i, i * 97 % 3001, i * j % 4001) for j in range(100)) for i in range(n)]
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n)), "_key": pa.array(range(n)), "text": texts}).select(names)


#: scan, its columns, what it may hold as a multiple of the batch (2 to 5 without slices, 1.1 for the score)
BUILD = {
    "score": (lambda d: quality.score(d, quality.Model()), ["doc_id", "text"], 0.5),
    "lines": (lambda d: linealign.line_table(keyed(d, "doc_id", "text"), whole=True), ["doc_id", "_key", "text"], 0.95),
    "sketches": (lambda d: nearcopies._nodes(keyed(d, "doc_id", "text"), 5, 8, 4, 0.8), ["doc_id", "_key", "text"], 2),
    "sequences": (lambda d: nearcopies._sequences(d.withColumnRenamed("doc_id", "node")), ["doc_id", "text"], 2),
    "prints": (lambda d: decontam.item_prints(d.withColumnRenamed("doc_id", "item_id"), "item_id", "text", 8, 13), ["doc_id", "text"], 2),
    "pieces": (lambda d: packing.pieces(d, TOKENIZER, ids=True), ["doc_id", "text"], 0.95),
}


@pytest.mark.parametrize("name", BUILD)
def test_working_memory_does_not_follow_the_batch(spark, monkeypatch, name):
    build, names, most = BUILD[name]
    scan = scans(spark, monkeypatch, build)[0]
    monkeypatch.setattr(packing, "TaskContext", type("Task", (), {"get": classmethod(lambda cls: cls()), "partitionId": lambda self: 0}))
    batch = big_batch(names)
    batch = batch.rename_columns(["item_id" if name == "prints" and c == "doc_id" else c for c in batch.schema.names])
    sum(b.num_rows for b in scan(iter([batch.slice(0, 50)])))  # tables and vocabulary that stay
    tracemalloc.start()
    rows = 0
    for b in scan(iter([batch])):
        rows += b.num_rows
        del b
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < most * batch.nbytes
