"""The column of entities: by name, else by the number of its values."""

from dataprobe.operators import rfm


def test_entity_column(spark):
    rows = [(f"free text {i}", "ab"[i % 2], f"kind {i % 5}", f"place {i % 7}", float(i)) for i in range(1500)]
    df = spark.createDataFrame(rows, "note string, half string, kind string, place string, price double")
    assert rfm.entity_column(df) == "kind"  # note has too many values, half too few
    assert rfm.entity_column(df.withColumnRenamed("place", "Customer")) == "Customer"
    assert rfm.entity_column(df.select("note", "half", "price")) is None
    assert rfm.entity_column(df.select("price")) is None
    assert rfm.entity_column(df.filter("false")) is None


def test_tiers_of_every_domain(spark):
    for domain, names in rfm.TIERS.items():
        got = rfm.strategies(spark, domain).orderBy("place").collect()
        assert [r.segment for r in got] == list(names) and [r.quartile for r in got] == [3, 2, 1, 0]
