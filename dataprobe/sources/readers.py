"""CSV, JSON and Parquet readers, format check, previews and named views."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

# fixed values: readable formats and separator candidates in order of preference
FORMATS = ("csv", "json", "parquet")
SEPARATORS = (",", ";", "\t")
_RAW = "_raw_line"
# possessive, so that a long quoted field does not nest
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'


class UnsupportedFormat(ValueError):
    pass


def _first_line(spark: SparkSession, path: str) -> str:
    rows = spark.read.text(path).limit(1).collect()
    return rows[0][0] if rows else ""


def detect_separator(header: str) -> str:
    """The comma unless the header has none and holds another candidate."""
    outside = re.sub(_QUOTED, "", header)
    return next((s for s in SEPARATORS if s in outside), SEPARATORS[0])


def detect_layout(spark: SparkSession, path: str) -> tuple[str, bool]:
    """(encoding, whether fields hold line breaks), from one scan of all lines.

    UTF-8 when every line is valid UTF-8, else Latin-1. A quoted field that goes on in the next line leaves an odd
    number of quotes in its first one.
    """
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    row = spark.read.text(path).agg(F.bool_or(~F.is_valid_utf8("value")).alias("bad"), F.bool_or(quotes % 2 == 1).alias("broken")).first()
    return ("ISO-8859-1" if row["bad"] else "UTF-8"), bool(row["broken"])


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    encoding: str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """CSV with a header. Rows with too many fields are dropped, short rows are padded with nulls.

    Pass ``schema``, ``encoding`` and ``multi_line`` on large inputs: without them the files are read once more to
    infer the first, and once to find the other two. Files are split over tasks, also where fields hold line breaks.
    """
    header = _first_line(spark, path)
    sep = detect_separator(header)
    if encoding is None or multi_line is None:
        found = detect_layout(spark, path)
        encoding = encoding or found[0]
        multi_line = found[1] if multi_line is None else multi_line
    if multi_line:
        return _read_broken_lines(spark, path, sep, encoding, schema)
    options = {"header": True, "sep": sep, "encoding": encoding, "escape": '"'}
    if schema is None:
        schema = spark.read.options(**options).csv(path, inferSchema=True).schema
    names = [f.name.lstrip("﻿").strip() for f in schema]
    schema = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, schema)])
    # a single field leaves no room for a wrong count
    if len(schema) == 1:
        return spark.read.options(**options).schema(schema).csv(path)
    with_raw = T.StructType(schema.fields + [T.StructField(_RAW, T.StringType(), True)])
    df = spark.read.options(**options).csv(
        path, schema=with_raw, mode="PERMISSIVE", columnNameOfCorruptRecord=_RAW, enforceSchema=True
    )
    return _without_long_rows(df, sep, len(schema))


def _without_long_rows(df: DataFrame, sep: str, fields: int) -> DataFrame:
    plain = F.regexp_replace(F.col(_RAW), _QUOTED, "")
    found = F.length(plain) - F.length(F.replace(plain, F.lit(sep), F.lit(""))) + 1
    return df.filter(F.col(_RAW).isNull() | (found <= fields)).drop(_RAW)


def _read_broken_lines(spark: SparkSession, path: str, sep: str, encoding: str, schema: T.StructType | None) -> DataFrame:
    """As ``read_csv``, for files whose quoted fields hold line breaks; each string of ``csv_records`` is one row."""
    records = csv_records(spark, path, encoding)
    options = {"sep": sep, "escape": '"'}
    head = _fields(csv_records(spark, path, encoding, header=True).limit(1), options)
    if schema is None:
        # inference over strings that are no file is only offered for an RDD of them
        guessed = spark.read.options(**options).csv(records.rdd.map(lambda r: r[0]), inferSchema=True).schema
        names = [n if n is not None else f"_c{i}" for i, n in enumerate(head)]
        kinds = [f.dataType for f in guessed] + [T.StringType()] * (len(names) - len(guessed))
        schema = T.StructType([T.StructField(n, k, True) for n, k in zip(names, kinds)])
    schema = T.StructType([T.StructField(f.name.lstrip("\ufeff").strip(), f.dataType, True) for f in schema])
    with_raw = T.StructType(schema.fields + [T.StructField(_RAW, T.StringType(), True)])
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in with_raw)
    row = F.from_csv("value", F.lit(ddl), options | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _RAW})
    rows = records.select(row.alias("r")).select("r.*")
    return rows.drop(_RAW) if len(schema) == 1 else _without_long_rows(rows, sep, len(schema))


def _fields(one: DataFrame, options: dict) -> list[str | None]:
    """The fields of a single record."""
    rows = one.collect()
    if not rows:
        return []
    return list(one.sparkSession.read.options(**options).csv(one.sparkSession.sparkContext.parallelize([rows[0][0]])).first())


def csv_records(spark: SparkSession, path: str, encoding: str = "UTF-8", header: bool = False) -> DataFrame:
    """``value``: the records of CSV files whose quoted fields may hold line breaks; with ``header`` only the first of each file.

    Files are read by many tasks, each a range of a file's lines. Whether a range begins inside a quoted field depends on
    the quotes before it, so a first pass takes the parity of each range and a running parity over the ranges of a file
    (one number per range) fixes how each begins. The second pass joins lines to records; the parts of a record that goes over a
    range's end, two per range at most, are put together by a window over them alone.
    """
    text = spark.read.option("lineSep", "\n").text(path)
    decoded = F.col("value") if encoding == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), decoded.alias("value"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd: dict[tuple[str, int], bool] = {}
    inside, last = False, None
    # one row per range
    for r in sorted(lines.groupBy("file", "start").agg((F.sum(quotes) % 2 == 1).alias("odd")).collect()):
        inside = inside and r["file"] == last
        odd[r["file"], r["start"]] = inside
        inside, last = inside != r["odd"], r["file"]
    begins = spark.sparkContext.broadcast(odd)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # kinds: 0 whole, 1 the end of a record begun in an earlier range, 2 its beginning, 3 a whole range inside one
        place, parts, open_, begun, first = None, [], False, False, False
        out: list[tuple] = []

        def close() -> None:
            if place is not None and parts:
                out.append((*place, 2 if begun else 3, first, "\n".join(parts)))

        for b in batches:
            for file, start, value in zip(*(b.column(i).to_pylist() for i in range(3))):
                if (file, start) != place:
                    close()
                    place, parts, open_ = (file, start), [], begins.value[file, start]
                    begun, first = not open_, start == 0
                if not open_ and not parts and not value.strip():
                    continue
                parts.append(value)
                if value.count('"') % 2:
                    open_ = not open_
                if not open_:
                    out.append((*place, 0 if begun else 1, first, "\n".join(parts)))
                    first, begun, parts = first and not begun, True, []
            yield batch(out)
            out.clear()
        close()
        yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 5, kinds)], ["file", "start", "kind", "first", "value"])

    found = lines.mapInArrow(scan, "file string, start long, kind int, first boolean, value string")
    # a range's end of an earlier record comes before the beginning of its own last one
    order = Window.partitionBy("file").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    parts = found.filter("kind > 0").withColumn("n", F.count_if(F.col("kind") == 2).over(order))
    whole = parts.groupBy("file", "n").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "value"))).alias("p"), F.max("first").alias("first"))
    whole = whole.select("first", F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"))
    every = found.filter("kind = 0").select("first", "value").unionByName(whole)
    return every.filter("first" if header else "not first").select(F.regexp_replace("value", "\r$", "").alias("value"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines (splittable), or one array of records per file."""
    as_array = _first_line(spark, path).lstrip("﻿ \t").startswith("[")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=as_array)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def format_of(path: str, fmt: str | None = None) -> str:
    found = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if found not in FORMATS:
        raise UnsupportedFormat(f"'.{found}' is not one of {', '.join(FORMATS)}")
    return found


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Read by extension or explicit format."""
    return {"csv": read_csv, "json": read_json, "parquet": read_parquet}[format_of(path, fmt)](spark, path)


def load_dataset(spark: SparkSession, raw_path: str, cleaned_path: str | None = None, fmt: str | None = None) -> DataFrame:
    """The cleaned table when it has been written, else the raw one."""
    if cleaned_path:
        try:
            return read_parquet(spark, cleaned_path)
        except AnalysisException:
            pass
    return read_table(spark, raw_path, fmt)


def inspect(spark: SparkSession, path: str, fmt: str | None = None, rows: int = 5) -> tuple[str, DataFrame]:
    """Format and a preview of the first rows."""
    found = format_of(path, fmt)
    return found, read_table(spark, path, found).limit(rows)


def register_view(spark: SparkSession, name: str, path: str, fmt: str | None = None) -> DataFrame:
    """Make a file queryable by name from SQL text."""
    if not re.fullmatch(r"[A-Za-z_]\w*", name):
        raise ValueError(f"not a view name: {name!r}")
    df = read_table(spark, path, fmt)
    df.createOrReplaceTempView(name)
    return df
