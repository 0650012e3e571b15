"""Incremental merge of a symbol graph that equals a full build.

A file's fragment is its definitions (file, symbol, node) and its references
(file, symbol). A reference binds to the one node that its symbol names in the
whole graph; a symbol with several definitions is ambiguous, one with none stays
a name. So an edge of a file that did not change can only change if its symbol is
in the delta: the symbols whose set of definitions differs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Graph:
    """Fragments of all files, and the edges (file, symbol, target, confidence) that they give."""

    definitions: DataFrame
    references: DataFrame
    edges: DataFrame


def resolve(references: DataFrame, definitions: DataFrame) -> DataFrame:
    """Edges of references: file, symbol, target (null unless one node is named) and confidence (RESOLVED, AMBIGUOUS, EXTRACTED).

    Definitions are counted by symbol before the join, so neither a symbol that a
    third of all files reference nor one with as many definitions makes pairs.
    Repeated definitions of one node count once, repeated references give one edge.
    """
    named = definitions.groupBy("symbol").agg(F.min("node").alias("node"), (F.min("node") == F.max("node")).alias("single"))
    confidence = F.when(F.col("single"), "RESOLVED").when(~F.col("single"), "AMBIGUOUS").otherwise("EXTRACTED")
    return references.select("file", "symbol").distinct().join(named, "symbol", "left").select("file", "symbol", F.when(F.col("single"), F.col("node")).alias("target"), confidence.alias("confidence"))


def build(definitions: DataFrame, references: DataFrame) -> Graph:
    """The whole graph from all fragments; rows without a file or symbol are none."""
    d, r = (x.where("file is not null and symbol is not null") for x in (definitions, references))
    d = d.where("node is not null")
    return Graph(d, r, resolve(r, d))


def symbol_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Symbols whose (symbol, node) rows differ between definitions of the changed files."""
    a, b = (x.select("symbol", "node").distinct() for x in (old, new))
    gone, come = a.join(b, ["symbol", "node"], "left_anti"), b.join(a, ["symbol", "node"], "left_anti")
    return gone.unionByName(come).select("symbol").distinct()


def merge(stored: Graph, changed: DataFrame, definitions: DataFrame, references: DataFrame) -> tuple[Graph, DataFrame]:
    """The graph after the files of ``changed`` (file) got new fragments (none: removed), and the references that were resolved again.

    Fragments and edges of changed files are retracted; of the others only
    references whose symbol is in the delta are resolved again, against the
    definitions of the symbols asked for; all other edges stay as stored.
    """
    files = changed.select("file").distinct()
    fresh = build(definitions, references)
    retract = lambda x: x.join(files, "file", "left_anti")
    delta = symbol_delta(stored.definitions.join(files, "file", "left_semi"), fresh.definitions)
    kept_definitions, kept_references = retract(stored.definitions), retract(stored.references)
    dependent = kept_references.join(delta, "symbol", "left_semi").select("file", "symbol").distinct()
    again = dependent.unionByName(fresh.references.select("file", "symbol").distinct())
    names = [c for c in stored.definitions.columns if c in fresh.definitions.columns]
    now = kept_definitions.select(names).unionByName(fresh.definitions.select(names))
    asked = now.join(again.select("symbol").distinct(), "symbol", "left_semi")
    untouched = retract(stored.edges).join(delta, "symbol", "left_anti")
    every = kept_references.select("file", "symbol").unionByName(fresh.references.select("file", "symbol"))
    return Graph(now, every, untouched.unionByName(resolve(again, asked))), dependent
