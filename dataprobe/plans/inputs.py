"""Inputs derived from the given tables, each as a DataFrame and as the same SQL.

The tables have no nulls and no duplicate rows, so the inputs of the cleaning queries get some from rules
on the keys; the question log and the statement log come from the conversation turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataprobe.plans.registry import table


def _t(spark, sf_dir, name):
    return table(spark, sf_dir, name)


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order line with its customer's region. Join sides are left to the planner's size checks."""
    li, o, c = (_t(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    n, r = (_t(spark, sf_dir, x) for x in ("nation", "region"))
    place = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name")
    buyers = c.join(place, c.c_nationkey == place.n_nationkey).select("c_custkey", "c_mktsegment", "n_name", "r_name")
    placed = o.join(buyers, o.o_custkey == buyers.c_custkey)
    return li.join(placed, li.l_orderkey == placed.o_orderkey).select(
        F.col("o_orderkey").alias("order_id"),
        F.to_date("o_orderdate").alias("order_date"),
        F.col("o_custkey").alias("customer_id"),
        F.col("r_name").alias("region"),
        F.col("n_name").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)").alias("revenue"),
    )


SALES = """sales AS (
  SELECT o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date, o_custkey AS customer_id,
         r_name AS region, n_name AS nation, c_mktsegment AS segment, o_orderpriority AS priority,
         l_quantity AS quantity, l_discount AS discount,
         CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)) AS revenue
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def sales_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sales with revenue cut to 30 % in ASIA in the first half of 1999."""
    hit = (F.col("region") == "ASIA") & F.col("order_date").between("1999-01-01", "1999-06-30")
    return sales(spark, sf_dir).withColumn(
        "revenue", F.when(hit, F.col("revenue") * F.lit("0.3").cast("decimal(2,1)")).otherwise(F.col("revenue")).cast("decimal(18,4)")
    )


SALES_PLANTED = SALES + """, planted AS (
  SELECT order_id, order_date, customer_id, region, nation, segment, priority, quantity, discount,
         CAST(CASE WHEN region = 'ASIA' AND order_date BETWEEN DATE '1999-01-01' AND DATE '1999-06-30'
                   THEN revenue * CAST('0.3' AS DECIMAL(2,1)) ELSE revenue END AS DECIMAL(18,4)) AS revenue
  FROM sales)"""


def events_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with nulls, duplicate rows, a constant column and a 0/1 column."""
    e = _t(spark, sf_dir, "events")
    every = lambda n: F.col("event_id") % n == 0
    base = e.select(
        "event_id",
        F.when(~every(33), F.col("ts")).alias("ts"),
        "user_id",
        F.when(~every(40), F.col("event_type")).alias("event_type"),
        F.when(~every(10), F.col("event_type")).alias("channel"),
        F.when(~every(50), F.col("value")).alias("value"),
        F.lit("x").alias("source"),
        (F.col("event_type") == "error").cast("int").alias("is_error"),
    )
    return base.unionByName(base.filter(every(97)))


EVENTS_DIRTY = """base AS (
  SELECT event_id, CASE WHEN event_id % 33 <> 0 THEN ts END AS ts, user_id,
         CASE WHEN event_id % 40 <> 0 THEN event_type END AS event_type,
         CASE WHEN event_id % 10 <> 0 THEN event_type END AS channel,
         CASE WHEN event_id % 50 <> 0 THEN value END AS value,
         'x' AS source, CAST(event_type = 'error' AS INTEGER) AS is_error
  FROM events),
dirty AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE event_id % 97 = 0)"""


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a fixed rule score, the input of the metric queries."""
    lab, doc = _t(spark, sf_dir, "labels"), _t(spark, sf_dir, "documents").select("doc_id", "n_chars")
    score = F.least(F.lit(1.0), F.col("n_chars") / 2000.0)
    return lab.join(doc, "doc_id").select(
        "doc_id", F.col("quality").alias("label"), score.alias("score"), (score >= 0.5).cast("int").alias("prediction")
    )


SCORED = """scored AS (
  SELECT l.doc_id, l.quality AS label, least(1.0, n_chars / 2000.0)::DOUBLE AS score,
         CAST(least(1.0, n_chars / 2000.0) >= 0.5 AS INTEGER) AS prediction
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


# the opening of each logged question; the turn's own text follows
QUESTION_OPENINGS = [
    "Why did revenue decrease?",
    "How did products perform?",
    "What is the top category?",
    "Show top 5 nations by revenue",
    "lowest 3 segments by discount",
    "Average quantity by region",
    "pie chart of revenue by segment",
    "How many orders per priority",
    "plot the revenue trend over time",
    "maximum revenue for 12 customers",
    "Which nation has the worst discount",
    "what about it",
]

_Q_ARRAY_SQL = "[" + ", ".join(f"'{q}'" for q in QUESTION_OPENINGS) + "]"


def question_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One question per conversation turn: an opening picked by the turn's keys, then its whole text."""
    openings = F.array(*[F.lit(q) for q in QUESTION_OPENINGS])
    pick = ((F.col("conv_id") * 5 + F.col("turn")) % len(QUESTION_OPENINGS) + 1).cast("int")
    return _t(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.element_at(openings, pick), F.lit(" "), F.col("text")).alias("question")
    )


QUESTIONS = f"""questions AS (
  SELECT conv_id, turn,
         {_Q_ARRAY_SQL}[CAST((conv_id * 5 + turn) % {len(QUESTION_OPENINGS)} + 1 AS INTEGER)] || ' ' || text AS question
  FROM conversations)"""

# the opening of each logged statement; the turn's text follows as a quoted literal or comment
STATEMENT_OPENINGS = [
    "SELECT * FROM orders WHERE note = ",
    "DROP TABLE orders; -- ",
    "SELECT * FROM orders; DELETE FROM users WHERE note = ",
    "UPDATE users SET role = ",
    "WITH t AS (SELECT credit_limit FROM customer) SELECT * FROM t WHERE note = ",
    "SELECT replace(name, 'a', 'b') FROM nation WHERE note = ",
    "SELECT 'please drop the table' AS credit_limit, ",
    "SELECT pg_sleep(5), ",
    "SELECT * FROM orders INTO OUTFILE ",
    "  select region, sum(revenue) from sales group by region having max(note) <> ",
    "EXPLAIN SELECT ",
]
_S_ARRAY_SQL = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in STATEMENT_OPENINGS) + "]"


def statement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    openings = F.array(*[F.lit(s) for s in STATEMENT_OPENINGS])
    pick = ((F.col("conv_id") * 3 + F.col("turn")) % len(STATEMENT_OPENINGS) + 1).cast("int")
    literal = F.concat(F.lit("'"), F.replace(F.col("text"), F.lit("'"), F.lit("''")), F.lit("'"))
    return _t(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.element_at(openings, pick), literal, F.lit(";")).alias("statement")
    )


STATEMENTS = f"""statements AS (
  SELECT conv_id, turn,
         {_S_ARRAY_SQL}[CAST((conv_id * 3 + turn) % {len(STATEMENT_OPENINGS)} + 1 AS INTEGER)]
           || '''' || replace(text, '''', '''''') || '''' || ';' AS statement
  FROM conversations)"""
