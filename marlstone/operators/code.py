"""Symbols and call edges of Python sources, by the interpreter's own parser (one row a file, Arrow batches)."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SYMBOL = "path string, name string, kind string, first_line bigint, last_line bigint, doc string"
CALL = "path string, caller string, callee string, confidence string"


def _tree(text: str | None):
    try:
        return ast.parse(text or "")
    except SyntaxError:
        return ast.parse("")


def python_symbols(sources: DataFrame) -> DataFrame:
    """Functions and classes of each source (path, text); a source that does not parse has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [
                (path, n.name, "class" if isinstance(n, ast.ClassDef) else "function", n.lineno, n.end_lineno, ast.get_docstring(n))
                for path, text in zip(pdf["path"], pdf["text"], strict=True)
                for n in ast.walk(_tree(text))
                if isinstance(n, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef)
            ]
            yield pd.DataFrame(rows, columns=["path", "name", "kind", "first_line", "last_line", "doc"])

    return sources.select("path", "text").mapInPandas(run, SYMBOL)


def python_calls(sources: DataFrame) -> DataFrame:
    """Call edges inside each source; a callee that the source does not define is external."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, text in zip(pdf["path"], pdf["text"], strict=True):
                tree = _tree(text)
                functions = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
                names = {n.name for n in functions}
                for f in functions:
                    for c in ast.walk(f):
                        if isinstance(c, ast.Call):
                            name = c.func.id if isinstance(c.func, ast.Name) else c.func.attr if isinstance(c.func, ast.Attribute) else None
                            if name:
                                rows.append((path, f.name, name if name in names else f"external::{name}", "RESOLVED" if name in names else "EXTRACTED"))
            yield pd.DataFrame(sorted(set(rows)), columns=["path", "caller", "callee", "confidence"])

    return sources.select("path", "text").mapInPandas(run, CALL)
