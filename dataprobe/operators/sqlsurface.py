"""Audit of SQL statements, and guarded read-only SQL over registered views."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: refused words and patterns
FORBIDDEN = (
    "DROP", "DELETE", "UPDATE", "INSERT", "ALTER", "TRUNCATE", "CREATE", "GRANT", "REVOKE", "EXEC", "EXECUTE", "SHUTDOWN", "MERGE",
    "REPLACE", "CALL", "RENAME",
)
SUSPICIOUS = (
    r"\b(reflect|java_method|try_reflect)\s*\(", r"\b(csv|json|text|parquet|orc|avro|binaryfile|delta|jdbc)\s*\.\s*`",
    r";\s*drop", r";\s*delete", r";\s*update", r"into\s+outfile", r"into\s+dumpfile", r"load_file\(", r"pg_sleep", r"waitfor\s+delay",
)
FIRST_WORDS = ("SELECT", "WITH")
# literals, quoted names and comments; possessive, so that long literals do not nest
_QUIET = (
    r"'[^']*+(?:''[^']*+)*+'" + r'|"[^"]*+(?:""[^"]*+)*+"' + r"|`[^`]*+`" + r"|--[^\n]*+" + r"|/\*[^*]*+\*++(?:[^/*][^*]*+\*++)*+/"
)


class UnsafeSQL(ValueError):
    pass


def audit_columns(statement: Column) -> dict[str, Column]:
    """Flags of one statement column."""
    cleaned = F.rtrim(F.trim(F.regexp_replace(F.coalesce(statement, F.lit("")), r"[;\s]+$", "")))
    code = F.regexp_replace(cleaned, _QUIET, " '' ")
    # comments and opening parentheses may stand before the first word
    word = F.upper(F.regexp_extract(code, r"^(?:\s|\(|'')*([A-Za-z_]+)", 1))
    return {
        "is_empty": cleaned == "",
        "first_word": word,
        "is_multiple": code.rlike(r";\s*\S"),
        "forbidden_word": F.upper(F.regexp_extract(code, r"(?i)\b(" + "|".join(FORBIDDEN) + r")\b", 1)),
        "is_suspicious": F.lower(cleaned).rlike("|".join(SUSPICIOUS)),
    }


def audit(statements: DataFrame, column: str = "statement") -> DataFrame:
    """Add the flags and a verdict: ``safe`` or the first rule that refuses the statement."""
    out = statements.withColumns(audit_columns(F.col(column)))
    verdict = (
        F.when(F.col("is_empty"), "empty")
        .when(F.col("is_multiple"), "multiple statements")
        .when(~F.col("first_word").isin(*FIRST_WORDS), "not a read statement")
        .when(F.col("forbidden_word") != "", "forbidden word")
        .when(F.col("is_suspicious"), "suspicious pattern")
        .otherwise("safe")
    )
    return out.withColumn("verdict", verdict)


def _relations(spark: SparkSession, text: str) -> list[str]:
    """The relations a statement reads, as the parser names them (``a, b`` for two parts)."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).treeString()
    return re.findall(r"'UnresolvedRelation \[([^\]]*)\]", plan)


def guarded_sql(spark: SparkSession, text: str, limit: int | None = 1000) -> DataFrame:
    """Run one read-only statement over the registered views, at most ``limit`` rows (None: all).

    The audit comes first because Spark runs a DDL text as soon as it is parsed. Relations must be registered views
    or names the statement itself defines: Spark would also read a path written as a relation.
    """
    checked = audit(spark.createDataFrame([(text,)], "statement string")).first()
    if checked["verdict"] != "safe":
        raise UnsafeSQL(f"{checked['verdict']}: {checked['forbidden_word'] or checked['first_word']}")
    text = text.strip().rstrip(";")
    own = {m.lower() for m in re.findall(r"(?i)(?:\bwith\b|,)\s*(?:recursive\s+)?`?(\w+)`?(?:\s*\([^()]*\))?\s+as\s*\(", text)}
    views = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    for name in _relations(spark, text):
        if name.lower() not in own | views:
            raise UnsafeSQL(f"not a registered view: {name}")
    out = spark.sql(text)
    return out if limit is None else out.limit(limit)
