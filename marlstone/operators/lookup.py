"""Exact search and lookups over any table of texts or names.

Asked-for words, names and rules are small tables that the caller states; they
are constants of the query, never the size of the corpus. Texts are never
shuffled: only hits are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.graph import checkpointed

#: A constant is a name, an equals sign and a quoted value.
CONSTANT = r'([A-Za-z_]+) = "([^"]*)"'


def text_lines(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """One row a line: the keys, line_no (from 0) and line. A null text has no lines."""
    return docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("bigint"))


def _any(column: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(column, F.lit(w))
    return out


def keyword(lines: DataFrame, words: list[str], *keys: str) -> DataFrame:
    """Lines that hold one of the words, once each: keys, line_no and the first word of the list that the line holds."""
    first = F.coalesce(*[F.when(F.contains("line", F.lit(w)), F.lit(w)) for w in words]) if words else F.lit(None).cast("string")
    return lines.select(*keys, "line_no", first.alias("matched_query")).where("matched_query is not null")


def top(df: DataFrame, *order: Column, limit: int, total: str) -> DataFrame:
    """The first rows in an order, each with the number of all rows; no row leaves its task but the ``limit`` least of it."""
    # TakeOrdered keeps the least rows of each task; the total is a scalar subquery of partial counts.
    counted = df.select(F.count("*").alias("n")).scalar()
    return df.orderBy(*order).limit(limit).withColumn(total, counted)


def pattern(lines: DataFrame, regex: str, *keys: str, ignore_case: bool = True, cap: int = 50, longest: int = 1 << 20) -> DataFrame:
    """Lines that a pattern matches, at most ``cap`` by key and line: keys, line_no, total_matches_found, truncated.

    Lines beyond ``longest`` characters are skipped.
    """
    rule = f"(?i){regex}" if ignore_case else regex
    hits = lines.where((F.length("line") <= longest) & F.col("line").rlike(rule)).select(*keys, "line_no")
    out = top(hits, *keys, "line_no", limit=cap, total="total_matches_found")
    return out.withColumn("truncated", F.col("total_matches_found") > cap)


def page(df: DataFrame, *order: Column, columns: list[str], size: int) -> DataFrame:
    """The first page of a listing: columns, total and has_more."""
    return top(df, *order, limit=size, total="total").select(*columns, "total", (F.col("total") > size).alias("has_more"))


def constants(docs: DataFrame, *keys: str, text: str = "text", form: str = CONSTANT) -> DataFrame:
    """Every constant of every text: keys, position (from 0), name, value."""
    every = F.posexplode(F.regexp_extract_all(text, F.lit(form), F.lit(0))).alias("position", "found")
    return docs.select(*keys, every).select(
        *keys,
        F.col("position").cast("bigint").alias("position"),
        F.regexp_extract("found", form, 1).alias("name"),
        F.regexp_extract("found", form, 2).alias("value"),
    )


def constants_by_name(found: DataFrame, names: list[str]) -> DataFrame:
    """Asked names with their least value and number of places; a name that nothing defines comes with null and 0."""
    hits = found.where(F.col("name").isin(names)).groupBy("name").agg(F.min("value").alias("value"), F.count("*").alias("n"))
    asked = found.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return asked.join(hits, "name", "left").select("name", "value", F.coalesce("n", F.lit(0)).alias("n"))


def outline(lines: DataFrame, key: str, is_name: Column) -> DataFrame:
    """Named stretches of each text: key, name, first_line, last_line (E9); a stretch ends before the next one."""
    by = Window.partitionBy(key).orderBy("line_no")
    ends = lines.groupBy(key).agg(F.max("line_no").alias("end"))
    names = lines.where(is_name).select(key, F.col("line").alias("name"), F.col("line_no").alias("first_line"), (F.lead("line_no").over(by) - 1).alias("next"))
    return names.join(ends, key).select(key, "name", "first_line", F.coalesce("next", "end").alias("last_line"))


def hover(lines: DataFrame, key: str, is_name: Column) -> DataFrame:
    """The enclosing name of each line: key, line_no, enclosing.

    Stretches do not overlap, so the narrowest is the last one begun: a running
    value within the text in place of a range join. Lines before the first name
    are left out.
    """
    by = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.select(key, "line_no", F.last(F.when(is_name, F.struct("line")), ignorenulls=True).over(by).alias("at"))
    return named.where("at is not null").select(key, "line_no", F.col("at.line").alias("enclosing"))


def definitions(nodes: DataFrame, labels: list[str], *, key: str, name: str) -> DataFrame:
    """Nodes that define a label: label, key, how.

    An equal name is exact; only labels without an exact hit fall back to names
    that contain them.
    """
    asked = F.explode(F.array(*[F.lit(x) for x in labels])).alias("label")
    hits = nodes.where(_any(F.col(name), labels)).select(key, name, asked).where(F.contains(name, F.col("label")))
    exact = F.col(name) == F.col("label")
    known = hits.where(exact).select("label").distinct()
    near = hits.where(~exact).join(known, "label", "left_anti").select("label", key, F.lit("substring").alias("how"))
    return hits.where(exact).select("label", key, F.lit("exact").alias("how")).unionByName(near)


#: Buckets of a reference, the first that fits counts.
BUCKETS = ("test", "definition", "import", "call", "read", "doc", "mention")


def reference_buckets(lines: DataFrame, symbols: list[str], *, in_tests: Column, in_docs: Column, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Lines that hold a symbol as a word, by bucket: symbol, bucket, hits, excluded.

    A line under test, one that assigns the symbol, imports it, calls it, reads a
    member or an item of it, one in a document, any other. Hits of excluded
    buckets are counted beside, so a total stays true.
    """
    held = lines.where(_any(F.col("line"), symbols)).select("line", in_tests.alias("in_tests"), in_docs.alias("in_docs"), F.explode(F.array(*[F.lit(s) for s in symbols])).alias("symbol"))
    word = lambda after: F.regexp_like("line", F.concat(F.lit(r"(^|[^A-Za-z0-9_])"), "symbol", F.lit(after)))
    held = held.where(F.contains("line", F.col("symbol")) & word(r"($|[^A-Za-z0-9_])"))
    bucket = (
        F.when(F.col("in_tests"), "test")
        .when(word(" = "), "definition")
        .when(F.col("line").rlike("^(import|from) "), "import")
        .when(word(r"\("), "call")
        .when(word(r"[.\[]"), "read")
        .when(F.col("in_docs"), "doc")
        .otherwise("mention")
    )
    out = F.col("bucket").isin(list(exclude)) if exclude else F.lit(False)
    return held.select("symbol", bucket.alias("bucket")).groupBy("symbol", "bucket").agg(
        F.count_if(~out).alias("hits"), F.count_if(out).alias("excluded")
    )


def by_prefix(nodes: DataFrame, asked: list[str], *, key: str, name: str) -> DataFrame:
    """Nodes whose name is an asked one or, where none is, begins with it: asked, key, how (E14: exact, prefix, ambiguous)."""
    every = F.array(*[F.lit(a) for a in asked])
    hits = nodes.select(key, name, F.explode(every).alias("asked")).where(F.col(name).startswith(F.col("asked")))
    hits = hits.withColumn("_exact", F.col(name) == F.col("asked"))
    told = hits.groupBy("asked").agg(F.max("_exact").alias("_any"), F.count("*").alias("_n"))
    how = F.when(F.col("_exact"), "exact").when(F.col("_n") == 1, "prefix").otherwise("ambiguous")
    return hits.join(told, "asked").where("_exact or not _any").select("asked", key, how.alias("how"))


def per_group_cap(df: DataFrame, group: str, *order: Column, cap: int, limit: int) -> DataFrame:
    """At most ``cap`` rows of a group and ``limit`` in all, in one order; a task keeps only the cap of each group before the shuffle (E5)."""
    ranked = df.withColumn("_place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_place") <= cap)
    return ranked.drop("_place").orderBy(*order).limit(limit)


def ranked(df: DataFrame, *order: Column, within: tuple[str, ...] = (), place: str = "place") -> DataFrame:
    """All rows with their place in one order, or within each group, from 1, without a window over a table or a group.

    Rows are sorted by ranges over all tasks, so that a group of any size is
    shared out; a task's first place is the number of rows in the tasks before
    it, one count each. A group's first row has the least place of the group.
    The sorted rows are checkpointed: ranges come from a sample, and a second
    sort could draw them elsewhere. Null is a group of its own.
    """
    at = df.orderBy(*within, *order).withColumn("_task", F.spark_partition_id()).withColumn("_in", F.monotonically_increasing_id())
    sorted_ = checkpointed(at)
    counts = sorted_.groupBy("_task").agg(F.count("*").alias("_n"))
    before = counts.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"))
    # One row a task: as many numbers as there are shuffle partitions.
    number = F.col("_before") + F.col("_in") - F.shiftleft(F.col("_task").cast("bigint"), 33) + 1
    out = sorted_.join(F.broadcast(before), "_task").withColumn(place, number).drop("_task", "_in", "_before")
    if not within:
        return out
    # Joined on a key without nulls, as adaptive execution then splits a hot group.
    key = F.to_json(F.struct(*within), {"ignoreNullFields": "false"})
    out = out.withColumn("_key", key)
    first = out.groupBy("_key").agg(F.min(place).alias("_first"))
    return out.join(first, "_key").withColumn(place, F.col(place) - F.col("_first") + 1).drop("_key", "_first")


def running_total(df: DataFrame, value: str, *order: Column, within: tuple[str, ...] = (), total: str = "upto", block: int = 1 << 16) -> DataFrame:
    """Each row with the sum of ``value`` up to it in an order, within its group, without a window over a group.

    Rows are ranked over all tasks; sums run within blocks of places and over the
    blocks' sums, of which there is one for ``block`` rows. Null counts as 0.
    """
    placed = ranked(df, *order, within=within, place="_place").withColumn("_block", F.floor(F.col("_place") / block).cast("bigint"))
    # A key without nulls, so that null is a group of its own in the join.
    placed = placed.withColumn("_group", F.to_json(F.struct(F.lit(0).alias("_"), *within), {"ignoreNullFields": "false"}))
    sums = placed.groupBy("_group", "_block").agg(F.coalesce(F.sum(value), F.lit(0)).alias("_sum"))
    earlier = Window.partitionBy("_group").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_group", "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = F.sum(F.coalesce(value, F.lit(0))).over(Window.partitionBy("_group", "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    out = placed.withColumn("_inside", inside).join(before, ["_group", "_block"])
    return out.withColumn(total, F.col("_before") + F.col("_inside")).drop("_group", "_block", "_place", "_inside", "_before")
