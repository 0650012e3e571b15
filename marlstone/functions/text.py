"""Column functions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Case-folded words; `_` stays inside a word. Null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_estimate(text: Column) -> Column:
    """Model tokens that a text is worth: a quarter of its UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint")


def redacted(value: Column) -> Column:
    """A secret with most of it hidden: nothing shown up to 8 characters, 2 + 2 below 20, then 4 + 4."""
    n = F.length(value)
    shown = lambda k: F.concat(F.substring(value, 1, k), F.lit("..."), F.substring(value, -k, k))
    return F.when(n <= 8, "[hidden]").when(n < 20, shown(2)).otherwise(shown(4))


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters, in bits."""
    letters = F.filter(F.split(value, ""), lambda c: c != "")
    n = F.size(letters)
    share = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / n)
    return F.aggregate(share, F.lit(0.0), lambda t, p: t - p * F.log2(p))


def lines(text: Column) -> Column:
    """Array of lines."""
    return F.split(F.coalesce(text, F.lit("")), "\n")
