"""Knowledge chunks about a table, retrieval of chunks for questions, suggested questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataprobe.functions.numeric import half_even, ratio
from dataprobe.operators import eda, roles
from dataprobe.operators.aggregates import value_counts_by_column
from dataprobe.operators.models import is_id_like
from dataprobe.operators.ordering import ranked_within
from dataprobe.operators.profile import profile, two_decimals
from dataprobe.operators.shape import TEMPORAL, columns_of
from dataprobe.scratch import materialise

# fixed values: keywords of each kind of chunk
OVERVIEW_WORDS = ["overview", "size", "rows", "columns", "dataset", "total", "count", "summary"]
GREETING_WORDS = ["hello", "hi", "help"]
NUMERIC_WORDS = ["numeric", "average", "mean", "max", "min", "median", "total", "sum"]
DATE_WORDS = ["date", "time", "period", "range", "when", "trend", "monthly", "daily", "over time", "history"]
CATEGORY_WORDS = ["category", "segment", "group", "which", "top", "best", "worst"]
CORRELATION_WORDS = ["correlation", "relationship", "impact", "drives", "affect", "cause", "why", "influence"]
DOMAIN_WORDS = ["business", "domain", "kpi", "metric", "performance"]
DOMAIN_VALUE_WORDS = ["revenue", "sales", "cost", "efficiency"]
DATE_PARTS = ("date", "time", "day", "month", "year")
TOP_VALUES, KEYWORD_VALUES = 10, 5


def _chunk(place: Column, id_: Column, keywords: Column, text: Column) -> list[Column]:
    return [place.cast("int").alias("place"), id_.alias("chunk_id"), keywords.alias("keywords"), text.alias("text")]


def knowledge_chunks(df: DataFrame, domain: str = "generic", exact: bool = True) -> DataFrame:
    """``place, chunk_id, keywords, text``: one row per column plus overview, correlations and domain.

    The table is written once, since every kind of chunk reads it. ``exact`` goes to the profile.
    """
    df = materialise(df, "known")
    numeric = columns_of(df, "numeric")
    dates = [f.name for f in df.schema if isinstance(f.dataType, TEMPORAL) or (f.name not in numeric and any(p in f.name.lower() for p in DATE_PARTS))]
    texts = [c for c in df.columns if c not in numeric and c not in dates]
    spaced = lambda c: F.lower(F.translate(c, "_", " "))
    facts = materialise(profile(df, exact), "known-profile").select("column_name", "position", "rows", "distinct_count", "missing_count")
    null_pct = F.format_string("%.1f", half_even(ratio(F.col("missing_count"), F.greatest(F.col("rows"), F.lit(1))) * 100, 1))
    n = len(df.columns)
    parts: list[DataFrame] = []

    total = df.agg(F.count(F.lit(1)).alias("rows"))
    overview = F.concat(
        F.lit("Dataset overview: "), F.format_number("rows", 0), F.lit(f" total records and {n} columns. "),
        F.lit(f"Domain classification: {domain}. Available attributes: {', '.join(df.columns)}."),
    )
    parts.append(total.select(*_chunk(F.lit(0), F.lit("overview"), F.lit(OVERVIEW_WORDS + [domain] + GREETING_WORDS), overview)))

    if numeric:
        s = eda.summary(df, numeric).withColumnRenamed("column", "column_name").join(F.broadcast(facts), "column_name")
        c = F.col("column_name")
        text = F.concat(
            F.format_string("Column '%s' (numeric): min=", c), two_decimals(F.col("min")), F.lit(", max="), two_decimals(F.col("max")),
            F.lit(", average="), two_decimals(F.col("mean")), F.lit(", median="), two_decimals(F.col("median")), F.lit(", std_dev="),
            two_decimals(F.col("std")), F.lit(", null_percent="), null_pct, F.format_string("%%, unique_values=%d.", "distinct_count"),
        )
        keys = F.concat(F.array(F.lower(c)), F.lit(NUMERIC_WORDS), F.array(spaced(c)))
        parts.append(s.select(*_chunk(F.col("position") + 1, F.concat(F.lit("col_num_"), c), keys, text)))

    if dates:
        day = lambda f, c: F.date_format(f(F.col(c).try_cast("timestamp")), "yyyy-MM-dd")
        row = df.agg(*[x for i, c in enumerate(dates) for x in (day(F.min, c).alias(f"a{i}"), day(F.max, c).alias(f"b{i}"))])
        structs = [F.struct(F.lit(c).alias("column_name"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b")) for i, c in enumerate(dates)]
        d = row.select(F.explode(F.array(*structs)).alias("s")).select("s.*").filter("a IS NOT NULL").join(F.broadcast(facts), "column_name")
        c = F.col("column_name")
        text = F.concat(F.format_string("Column '%s' (date/time): date range from %s to %s. Null percent=", c, "a", "b"), null_pct, F.lit("%."))
        parts.append(d.select(*_chunk(F.col("position") + 1, F.concat(F.lit("col_date_"), c), F.concat(F.array(F.lower(c)), F.lit(DATE_WORDS)), text)))

    if texts:
        counts = value_counts_by_column(df, texts)
        top = ranked_within(counts, ["column"], [F.col("count").desc(), F.col("value")], TOP_VALUES)
        lists = top.groupBy("column").agg(F.array_sort(F.collect_list(F.struct("rank", "value", "count"))).alias("top"))
        t = lists.withColumnRenamed("column", "column_name").join(F.broadcast(facts), "column_name")
        c = F.col("column_name")
        listed = F.array_join(F.transform("top", lambda x: F.concat(F.lit("'"), x["value"], F.lit("' ("), F.format_number(x["count"], 0), F.lit(")"))), ", ")
        text = F.concat(
            F.format_string("Column '%s' (categorical): %d unique values. Top values: ", c, "distinct_count"), listed,
            F.lit(". Null percent="), null_pct, F.lit("%."),
        )
        values = F.transform(F.slice("top", 1, KEYWORD_VALUES), lambda x: F.lower(x["value"]))
        keys = F.concat(F.array(F.lower(c)), F.lit(CATEGORY_WORDS), F.array(spaced(c)), values)
        parts.append(t.select(*_chunk(F.col("position") + 1, F.concat(F.lit("col_cat_"), c), keys, text)))

    plain = [c for c in numeric if not is_id_like(c, ("id", "uuid", "code"))]
    if len(plain) >= 2:
        pairs = eda.strong_pairs(df, columns=plain).withColumn("_o", F.array_position(F.lit(plain), F.col("x")) * len(plain) + F.array_position(F.lit(plain), F.col("y")))
        one = pairs.agg(F.array_sort(F.collect_list(F.struct("_o", "x", "y", "correlation"))).alias("p")).filter(F.size("p") > 0)
        listed = F.array_join(
            F.transform("p", lambda s: F.concat(F.lit("'"), s["x"], F.lit("' & '"), s["y"], F.lit("' (r="), two_decimals(s["correlation"]), F.lit(")"))), "; "
        )
        text = F.concat(F.lit("Significant correlations found: "), listed, F.lit("."))
        keys = F.lit(CORRELATION_WORDS + [c.lower() for c in plain[:6]])
        parts.append(one.select(*_chunk(F.lit(n + 1), F.lit("correlations"), keys, text)))

    metrics, risks, _ = roles.DOMAIN_COLUMNS.get(domain, roles.DOMAIN_COLUMNS["generic"])
    lower = {c.lower(): c for c in df.columns}
    found, risky = [lower[m] for m in metrics if m in lower], [lower[r] for r in risks if r in lower]
    if found:
        text = F.lit(
            f"Domain context ({domain}): Primary KPI columns detected: {', '.join(found)}. "
            f"Risk/efficiency columns: {', '.join(risky) or 'none detected'}."
        )
        keys = F.lit(DOMAIN_WORDS + [domain] + DOMAIN_VALUE_WORDS + [m.lower() for m in found])
        parts.append(total.select(*_chunk(F.lit(n + 2), F.lit("domain_context"), keys, text)))

    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def question_tokens(question: Column) -> Column:
    """Distinct lower-case words with question marks, commas and full stops removed."""
    plain = F.trim(F.regexp_replace(F.lower(question), r"[?,.]", ""))
    return F.array_distinct(F.filter(F.split(plain, r"\s+"), lambda t: t != ""))


def chunk_tokens(chunks: DataFrame) -> DataFrame:
    """``place, token, weight``: 3 for a keyword, 1 for a word of the text, 4 for both."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda t: t != ""))
    keys = chunks.select("place", F.explode(F.array_distinct("keywords")).alias("token"), F.lit(3).alias("w"))
    text = chunks.select("place", F.explode(words).alias("token"), F.lit(1).alias("w"))
    return keys.unionByName(text).groupBy("place", "token").agg(F.sum("w").alias("weight"))


def retrieve(questions: DataFrame, chunks: DataFrame, key: list[str], text: str = "question", top_k: int = 4, fallback: int = 3) -> DataFrame:
    """``key..., rank, chunk_id, score``: the best chunks of each question, the first three when none matches.

    Chunks of a table's columns are few, and the planner broadcasts them by their size; a larger set is joined by
    shuffle, where Spark splits the rows of a very common word.
    """
    tokens = chunk_tokens(chunks)
    asked = questions.select(*key, F.explode(question_tokens(F.col(text))).alias("token"))
    scores = asked.join(tokens, "token").groupBy(*key, "place").agg(F.sum("weight").alias("score"))
    best = ranked_within(scores, key, [F.col("score").desc(), F.col("place")], top_k)
    unmatched = questions.select(*key).join(best.select(*key).distinct(), key, "left_anti")
    first = chunks.orderBy("place").limit(fallback).agg(F.array_sort(F.collect_list("place")).alias("_f"))
    default = unmatched.crossJoin(F.broadcast(first)).select(*key, F.posexplode("_f").alias("_i", "place"))
    default = default.select(*key, "place", F.lit(0).cast("long").alias("score"), (F.col("_i") + 1).alias("rank"))
    both = best.select(*key, "place", "score", "rank").unionByName(default)
    ids = chunks.select("place", "chunk_id")
    return both.join(ids, "place").select(*key, "rank", "chunk_id", "score")


def suggested_questions(profiles: DataFrame, domain: str = "generic", limit: int = 7) -> DataFrame:
    """``place, prompt`` from the roles of the profiled columns."""
    spark = profiles.sparkSession
    rows = profiles.select("column_name", "family").collect()  # one row per column
    lower = {r["column_name"].lower(): r["column_name"] for r in rows}
    numbers = [r["column_name"] for r in rows if r["family"] in ("integer", "float") and not is_id_like(r["column_name"], ("id", "uuid", "code"))]
    texts = [r["column_name"] for r in rows if r["family"] == "string" and not is_id_like(r["column_name"], ("id", "uuid", "code"))]
    dates = [r["column_name"] for r in rows if any(p in r["column_name"].lower() for p in ("date", "time", "day"))]
    metrics, risks, dims = roles.DOMAIN_COLUMNS.get(domain, roles.DOMAIN_COLUMNS["generic"])
    named = lambda cands, spare: next((lower[c] for c in cands if c in lower), spare)
    primary = named(metrics, numbers[0] if numbers else None)
    dim = named(dims, texts[0] if texts else None)
    risk = named(risks, numbers[1] if len(numbers) > 1 else None)
    say = lambda c, default: c.replace("_", " ") if c else default
    m, d = say(primary, "performance"), say(dim, "category")
    out = []
    if primary:
        out += [f"Why did {m} decrease?", f"Which {d} has the highest {m}?", f"Show top 10 by {m}."]
        if dates:
            out.append(f"Show monthly {m} trend.")
    if risk:
        out.append(f"What drives {say(risk, '')} the most?")
    if len(numbers) >= 2:
        out.append(f"How does {say(numbers[0], '')} correlate with {say(numbers[1], '')}?")
    out += ["Find unusual patterns in the data.", "Give me a full summary of this dataset."]
    return spark.createDataFrame([(i + 1, p) for i, p in enumerate(out[:limit])], "place int, prompt string")
