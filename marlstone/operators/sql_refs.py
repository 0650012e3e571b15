"""Table references of SQL statements.

The session's own parser cannot run on executors, so statements are read by
patterns there, in the row: what follows FROM or JOIN is read, what follows
INSERT INTO, UPDATE or MERGE INTO is written; names of common table expressions
are left out. Statements without a leading keyword are no SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KEYWORD = r"^\s*(select|with|insert|update|merge|delete|create)\b"


def _names(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def table_references(spark: SparkSession, statements: DataFrame, *, key: str = "id", column: str = "statement") -> DataFrame:
    """key, access (read or write) and table of each statement."""
    text = F.lower(column)
    rows = statements.where(text.rlike(_KEYWORD)).select(
        key,
        _names(text, r"\b(?:from|join)\s+([a-z_][a-z0-9_.]*)").alias("reads"),
        _names(text, r"\b(?:insert\s+into|merge\s+into|update|create\s+table)\s+([a-z_][a-z0-9_.]*)").alias("writes"),
        _names(text, r"\b([a-z_][a-z0-9_]*)\s+as\s*\(").alias("own"),
    )
    each = F.concat(
        F.transform(F.array_except("reads", "own"), lambda t: F.struct(F.lit("read").alias("access"), t.alias("table"))),
        F.transform("writes", lambda t: F.struct(F.lit("write").alias("access"), t.alias("table"))),
    )
    return rows.select(key, F.explode(each).alias("ref")).select(key, "ref.access", "ref.table")


def embedded_references(spark: SparkSession, sources: DataFrame) -> DataFrame:
    """References of SQL literals at known sinks; formatted strings are refused, other strings are not looked at."""
    literal = F.regexp_extract("text", r'\bexecute\("([^"]*)"', 1)
    rows = sources.select("path", literal.alias("statement")).where("statement != ''")
    return table_references(spark, rows, key="path")
