"""Sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from dataprobe.plans.registry import query, table
from dataprobe.scratch import scratch_path
from dataprobe.sources import readers, sinks


def _round_trip(spark, sf_dir, write, read, suffix):
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("o_day"), "o_orderpriority"
    )
    path = scratch_path(spark, "orders") + suffix
    write(o, path)
    return _by_status(read(spark, path))


def _by_status(df):
    return df.groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("o_orderkey").alias("keys"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total"),
        F.date_format(F.max(F.col("o_day").cast("date")), "yyyy-MM-dd").alias("last_day"),
        F.max("o_orderpriority").alias("last_priority"),
    )


BY_STATUS = """
SELECT o_orderstatus, count(*) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS keys,
       CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
       strftime(max(o_orderdate), '%Y-%m-%d') AS last_day, max(o_orderpriority) AS last_priority
FROM orders GROUP BY o_orderstatus"""


@query("scan_csv", BY_STATUS)
def scan_csv(spark, sf_dir):
    return _round_trip(spark, sf_dir, sinks.write_csv, readers.read_csv, ".csv")


@query("scan_json", BY_STATUS)
def scan_json(spark, sf_dir):
    return _round_trip(spark, sf_dir, sinks.write_json, readers.read_json, ".json")


@query(
    "scan_parquet",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity
       FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY ALL""",
)
def scan_parquet(spark, sf_dir):
    li = readers.read_table(spark, f"{sf_dir}/lineitem.parquet")
    early = li.filter(F.col("l_shipdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    return early.groupBy("l_returnflag", "l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")
    )


@query(
    "sql_view_agg",
    """SELECT c_mktsegment AS label, round_even(avg(c_acctbal), 2) AS value, count(*) AS count
       FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment""",
)
def sql_view_agg(spark, sf_dir):
    readers.register_view(spark, "probe_customer", f"{sf_dir}/customer.parquet")
    return spark.sql(
        """SELECT c_mktsegment AS label, bround(avg(c_acctbal), 2) AS value, count(*) AS count
           FROM probe_customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment"""
    )


@query("sink_parquet_roundtrip", BY_STATUS)
def sink_parquet_roundtrip(spark, sf_dir):
    return _round_trip(spark, sf_dir, sinks.write_parquet, readers.read_parquet, ".parquet")


EVENT_SUMS = """
SELECT event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total,
       count(DISTINCT props) AS distinct_props
FROM events GROUP BY event_type"""


def _event_sums(df):
    return df.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"),
        F.count_distinct("props").alias("distinct_props"),
    )


@query("sink_json_roundtrip", EVENT_SUMS)
def sink_json_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    path = sinks.write_json(e, scratch_path(spark, "events") + ".json")
    return _event_sums(readers.read_json(spark, path, e.schema))


@query("sink_csv_text_roundtrip", "SELECT role, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT text) AS texts FROM conversations GROUP BY role")
def sink_csv_text_roundtrip(spark, sf_dir):
    """Texts with line breaks, quotes and separators, written and read with all that is to be detected."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    back = readers.read_csv(spark, sinks.write_csv(c, scratch_path(spark, "conversations") + ".csv"))
    return back.groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.count_distinct("text").alias("texts"))


@query("sink_csv_roundtrip", EVENT_SUMS)
def sink_csv_roundtrip(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value", "props")
    path = sinks.write_csv(e, scratch_path(spark, "events") + ".csv")
    return _event_sums(readers.read_csv(spark, path, e.schema, encoding="UTF-8"))
