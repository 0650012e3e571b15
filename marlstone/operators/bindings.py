"""Binding of names to nodes: unique matches, inheritance, injection, imports, doc references and SQL recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.graph import checkpointed


def resolved(asked: DataFrame, nodes: DataFrame, *, name: str, label: str, key: str, prefix: str = "", external: str = "external::") -> DataFrame:
    """Asked names with the one node of that label, else an external name: name, target."""
    known = nodes.groupBy(F.col(label).alias(name)).agg(F.count("*").alias("_n"), F.min(key).alias("_key"))
    own = asked.select(name).distinct().join(known, name, "left")
    return own.select(name, F.when(F.col("_n") == 1, F.concat(F.lit(prefix), F.col("_key").cast("string"))).otherwise(F.concat(F.lit(external), name)).alias("target"))


def supertypes(inherits: DataFrame, *, most: int = 8) -> DataFrame:
    """All supertypes of each type by a bounded walk: sub, super, hop (the least; cycles end, no type is its own)."""
    step = inherits.where("sub != super").select("sub", F.col("super").alias("node"))
    reach = step.select("sub", F.col("node").alias("super"), F.lit(1).alias("hop")).distinct()
    edge = step.select(F.col("sub").alias("super"), F.col("node").alias("next"))
    for hop in range(2, most + 1):
        last = reach.where(F.col("hop") == hop - 1)
        grown = last.join(edge, "super").select("sub", F.col("next").alias("super")).where("sub != super").distinct()
        new = checkpointed(grown.join(reach, ["sub", "super"], "left_anti").withColumn("hop", F.lit(hop)))
        if new.isEmpty():
            break
        reach = checkpointed(reach.unionByName(new))
    return reach


def dispatch(methods: DataFrame, inherits: DataFrame, *, most: int = 8) -> DataFrame:
    """Methods of subtypes that a call of a supertype's method may reach: seed, method, also."""
    own = methods.select("owner", "method").distinct()
    below = supertypes(inherits, most=most).select(F.col("super").alias("seed"), F.col("sub").alias("also"))
    seeds = own.select(F.col("owner").alias("seed"), "method").join(below, "seed")
    return seeds.join(own.withColumnRenamed("owner", "also"), ["also", "method"]).select("seed", "method", "also")


def inherited(methods: DataFrame, inherits: DataFrame, *, most: int = 8) -> DataFrame:
    """Methods that a type does not define itself, bound to the one definer among its nearest supertypes: sub, method, bound.

    Nearest by hops; if several of the nearest define it, bound is null.
    """
    own = methods.select("owner", "method").distinct()
    found = supertypes(inherits, most=most).join(own.withColumnRenamed("owner", "super"), "super")
    found = found.join(own.withColumnRenamed("owner", "sub"), ["sub", "method"], "left_anti")
    near = found.groupBy("sub", "method", "hop").agg(F.count("*").alias("n"), F.min("super").alias("super"))
    least = near.groupBy("sub", "method").agg(F.min(F.struct("hop", "n", "super")).alias("at"))
    return least.select("sub", "method", F.when(F.col("at.n") == 1, F.col("at.super")).alias("bound"))


def injected(binds: DataFrame, injects: DataFrame, *, external: str = "external::") -> DataFrame:
    """Consumers with the implementation that their port is bound to: consumer, target.

    A port that is bound to several implementations, or to none, stays external.
    """
    one = binds.groupBy("port").agg(F.count_distinct("impl").alias("n"), F.min("impl").alias("impl")).where("n = 1")
    return injects.join(one, "port", "left").select("consumer", F.coalesce("impl", F.concat(F.lit(external), "port")).alias("target"))


def scoped(definitions: DataFrame, uses: DataFrame) -> DataFrame:
    """Uses of a name bound to the one definition in their own scope: name, scope, bound (G42); null if there is none or several."""
    one = definitions.groupBy("name", "scope").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    return uses.select("name", "scope").distinct().join(one, ["name", "scope"], "left").select("name", "scope", F.when(F.col("n") == 1, F.col("id")).alias("bound"))


def doc_references(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, least: int = 6, span: str = "`([^`]+)`") -> DataFrame:
    """Labels that documents name in code spans: key, term, confidence.

    A span of ``least`` characters or more names a label that equals it; a span
    with dots names one that equals its last part, of any length. One node of
    the label makes the reference EXTRACTED, several AMBIGUOUS.
    """
    spans = docs.select(key, F.explode(F.regexp_extract_all(text, F.lit(span), F.lit(1))).alias("term"))
    dotted = F.contains("term", F.lit("."))
    terms = spans.select(key, F.when(dotted, F.substring_index("term", ".", -1)).otherwise(F.col("term")).alias("term"), dotted.alias("dotted"))
    terms = terms.where((F.length("term") >= least) | F.col("dotted")).select(key, "term").distinct()
    counted = labels.groupBy(F.col(label).alias("term")).agg(F.count("*").alias("n"))
    return terms.join(counted, "term").select(key, "term", F.when(F.col("n") == 1, "EXTRACTED").otherwise("AMBIGUOUS").alias("confidence"))


#: How a line of each language imports a module; the first group is the module.
IMPORTS = {"py": r"^\s*(?:import|from) ([A-Za-z_][A-Za-z0-9_.]*)", "js": r"^\s*import .*from ['\"]([^'\"]+)['\"]", "go": r"^\s*import \"([^\"]+)\"", "java": r"^\s*import (?:static )?([A-Za-z_][A-Za-z0-9_.]*);"}


def import_edges(lines: DataFrame, *, path: str = "path", line: str = "line") -> DataFrame:
    """Modules that files import by the form of the language that their suffix names: path, module."""
    module = F.lit(None).cast("string")
    for suffix, form in IMPORTS.items():
        module = F.when(F.col(path).endswith(f".{suffix}"), F.regexp_extract(line, form, 1)).otherwise(module)
    return lines.select(F.col(path).alias("path"), module.alias("module")).where("module != ''").distinct()


def reverse_imports(edges: DataFrame, files: DataFrame, *, path: str = "path") -> DataFrame:
    """Imports that name a file: path, imports (G33); a module stands for its path with dots as slashes and the suffix of the importer."""
    suffix = F.substring_index("path", ".", -1)
    named = edges.select("path", F.concat(F.translate("module", ".", "/"), F.lit("."), suffix).alias("imports"))
    return named.join(files.select(F.col(path).alias("imports")).distinct(), "imports", "left_semi").select("path", "imports")


def recovered_tables(statements: DataFrame, *, key: str, body: str, longest: int = 1 << 20) -> DataFrame:
    """Tables that broken SQL still creates: key, tables, provenance, unrecovered.

    Comments and quoted strings are masked first, only statements at the start
    of a line count, and a body beyond ``longest`` characters is not scanned.
    ``unrecovered`` counts lines that begin with CREATE TABLE but name no table.
    """
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(body), "/\\*[\\s\\S]*?\\*/", " "), "--[^\\n]*", " "), "'[^']*'", "''")
    at = F.when(F.length(body) <= longest, masked).otherwise(F.lit(""))
    named = F.regexp_extract_all(at, F.lit(r"(?m)^\s*create table (?:if not exists )?([a-z0-9_.]+)"), F.lit(1))
    begun = F.size(F.regexp_extract_all(at, F.lit(r"(?m)^\s*create table\b"), F.lit(0)))
    out = statements.select(key, F.array_sort(F.array_distinct(named)).alias("found"), (begun - F.size(named)).cast("bigint").alias("unrecovered"))
    return out.where("size(found) > 0 or unrecovered > 0").select(key, F.array_join("found", ",").alias("tables"), F.lit("recovered").alias("provenance"), "unrecovered")
