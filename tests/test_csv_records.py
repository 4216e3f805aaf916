import csv
import random

import pytest

from dataprobe.sources import readers, sinks


def write(path, rows, end="\r\n"):
    with open(path, "w", newline="", encoding="utf-8") as f:
        csv.writer(f, lineterminator=end).writerows(rows)


def odd_rows(n, seed):
    rng = random.Random(seed)
    bits = ["plain", 'say "so"', "a,b", "two\nlines", "\n\nthree\n", '"', '""', "é\n日本", "x" * 90, "", " padded "]
    return [[str(i), "".join(rng.choices(bits, k=rng.randrange(1, 6))), rng.choice(bits)] for i in range(n)]


@pytest.mark.parametrize("size", [64, 331, 4096])
def test_records_over_many_ranges(spark, tmp_path, size):
    rows = odd_rows(150, size)
    for name in ("one.csv", "two.csv"):
        write(tmp_path / name, [["id", "a", "b"], *rows], "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        records = readers.csv_records(spark, str(tmp_path))
        parsed = [next(csv.reader([r.value + "\n"] if "\n" not in r.value else r.value.splitlines(keepends=True))) for r in records.collect()]
        assert sorted(parsed) == sorted([*rows, *rows])
        df = readers.read_csv(spark, str(tmp_path / "one.csv"))
        back = sorted([str(r.id), r.a or "", r.b or ""] for r in df.collect())
        assert readers.csv_records(spark, str(tmp_path / "one.csv")).rdd.getNumPartitions() >= 1
        assert spark.read.text(str(tmp_path / "one.csv")).rdd.getNumPartitions() > 1 or size == 4096
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert back == sorted(rows)
    assert df.schema["id"].dataType.simpleString() == "int" and df.columns == ["id", "a", "b"]


def test_line_ends_long_rows_and_latin(spark, tmp_path):
    rows = [["id", "a", "b"], ["1", "x\r\ny", "2"], ["2", "too", "many", "fields"], ["3", "short"], ["4", "é", "ok"]]
    write(tmp_path / "mixed.csv", rows)
    got = sorted((r.id, r.a, r.b) for r in readers.read_csv(spark, str(tmp_path / "mixed.csv")).collect())
    assert got == [(1, "x\r\ny", "2"), (3, "short", None), (4, "é", "ok")] or got == [(1, "x\r\ny", 2), (3, "short", None), (4, "é", None)]
    (tmp_path / "latin.csv").write_bytes('id,a\n1,"é\nü"\n2,ß\n'.encode("latin-1"))
    got = sorted((r.id, r.a) for r in readers.read_csv(spark, str(tmp_path / "latin.csv")).collect())
    assert got == [(1, "é\nü"), (2, "ß")]


def test_unfinished_quote_and_empty_file(spark, tmp_path):
    (tmp_path / "open.csv").write_text('id,a\n1,x\n2,"never closed\n3,y\n')
    assert [r.value for r in readers.csv_records(spark, str(tmp_path / "open.csv")).collect()] == ["1,x", '2,"never closed\n3,y']
    (tmp_path / "none.csv").write_text('id,"a\nb"\n')
    df = readers.read_csv(spark, str(tmp_path / "none.csv"))
    assert df.columns == ["id", "a\nb"] and df.count() == 0


def test_round_trip_is_read_by_several_tasks(spark, tmp_path):
    text = spark.range(400).selectExpr("id", "concat('line\n', repeat('\"q\", ', 20), id) AS t")
    path = sinks.write_csv(text.coalesce(1), str(tmp_path / "big.csv"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = readers.read_csv(spark, path)
        assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() >= 8
        assert sorted(map(tuple, df.collect())) == sorted(map(tuple, text.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
