"""Secret and content scanning: rules over lines, findings and their life cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import entropy, lines, redacted

#: id, order, keyword that a line must hold, pattern (fixed values of the built-in rule set).
RULES = (
    ("token", 1, "token", '[a-z_]*token[a-z_]* = "[^"]*"'),
    ("email", 2, "@", "[A-Za-z0-9._-]+@[A-Za-z0-9.-]+"),
    ("phone", 3, "(", "[+][0-9]+ [(][0-9]+[)] [0-9-]+"),
    ("address", 4, ".", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+"),
    ("license", 5, "icens", "[Ll]icensed? under"),
)


def _placed(line: Column, matches: Column) -> Column:
    """Each of a line's matches, in order, with its first character (from 1): sought from the end of the one before."""
    none = F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<matched:string,start:int>>").alias("found"))

    def add(told: Column, m: Column) -> Column:
        start = F.call_function("locate", m, line, told["next"])
        return F.struct((start + F.length(m)).alias("next"), F.concat(told["found"], F.array(F.struct(m.alias("matched"), start.alias("start")))).alias("found"))

    return F.aggregate(matches, none, add)["found"]


def scan(docs: DataFrame, *, rules=RULES, key: str = "doc_id", most_bytes: int = 5 << 20, most_line: int = 32 << 10) -> DataFrame:
    """Every rule's matches in every line: key, line_no, rule, ord, start, stop, matched.

    The rules are few and become columns of the row, so there is no join; a
    rule's pattern runs only on lines that hold its keyword. Longer files and
    lines than the bounds are not scanned, which is the operator's contract.
    Places are right for patterns that look at nothing beside their match.
    """
    rows = docs.where(F.octet_length("text") <= most_bytes).select(key, F.posexplode(lines(F.col("text"))).alias("line_no", "line"))
    rows = rows.where(F.octet_length("line") <= most_line)
    hits = [
        F.when(
            F.contains("line", F.lit(word)),
            F.transform(
                _placed(F.col("line"), F.regexp_extract_all("line", F.lit(pattern), F.lit(0))),
                lambda m: F.struct(F.lit(rule).alias("rule"), F.lit(n).alias("ord"), m["matched"].alias("matched"), m["start"].cast("bigint").alias("start")),  # noqa: B023
            ),
        ).otherwise(F.array().cast("array<struct<rule:string,ord:int,matched:string,start:bigint>>"))
        for rule, n, word, pattern in rules
    ]
    found = rows.select(key, F.col("line_no").cast("bigint").alias("line_no"), F.explode(F.concat(*hits)).alias("hit")).select(key, "line_no", "hit.*")
    return found.withColumn("stop", F.col("start") + F.length("matched"))


def without_overlaps(found: DataFrame, *, key: str = "doc_id") -> DataFrame:
    """Of overlapping spans of a line the rule that comes first stays; disjoint ones all do (groups are single lines)."""
    earlier = found.select(key, "line_no", F.col("ord").alias("ord_b"), F.col("start").alias("start_b"), F.col("stop").alias("stop_b"))
    a, b = found.alias("a"), earlier.alias("b")
    same = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.line_no") == F.col("b.line_no"))
    over = (F.col("ord_b") < F.col("a.ord")) & (F.col("start_b") < F.col("a.stop")) & (F.col("a.start") < F.col("stop_b"))
    return a.join(b, same & over, "left_anti")


def high_entropy(found: DataFrame, *, least: float) -> DataFrame:
    return found.withColumn("entropy", entropy(F.col("matched"))).where(F.col("entropy") >= least)


def allowed(found: DataFrame, *, words: list[str], pattern: str) -> DataFrame:
    """Drop matches that an allow list of words or a value pattern covers."""
    cond: Column = F.col("matched").rlike(pattern)
    for w in words:
        cond = cond | F.contains(F.lower("matched"), F.lit(w))
    return found.where(~cond)


def merged_findings(before: DataFrame, now: DataFrame, *, keys: list[str]) -> DataFrame:
    """New matches are pending, decided ones keep their status, pending ones that a full scan no longer sees go."""
    b, n = before.select(*keys, F.col("status").alias("old")), now.select(*keys).distinct().withColumn("seen", F.lit(True))
    both = b.join(n, keys, "full_outer")
    return both.where(F.col("seen") | (F.col("old") != "pending")).select(*keys, F.coalesce("old", F.lit("pending")).alias("status"))


def shown(found: DataFrame) -> DataFrame:
    return found.withColumn("matched", redacted(F.col("matched")))


def first_per(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("own_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("own_n = 1").drop("own_n")
