"""Lists kept as one comma-separated text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(column: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(column, r"^\s+|\s+$", "")


def split_list(column: str | Column) -> Column:
    """Items of a comma list, trimmed, without empty ones. NULL gives an empty array."""
    col = F.col(column) if isinstance(column, str) else column
    items = F.filter(F.split(strip(col), r"\s*,\s*"), lambda item: item != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def split_cart(column: str | Column) -> Column:
    """Items of a list literal such as ``['a', 'b']``; ``nan`` items and brackets are dropped."""
    col = F.col(column) if isinstance(column, str) else column
    items = split_list(F.regexp_replace(col, r"[\[\]'\"]", ""))
    return F.filter(items, lambda item: F.lower(item) != "nan")


def joined(items: Column) -> Column:
    """Comma list of an array; NULL for an empty one."""
    return F.when(F.size(items) > 0, F.array_join(items, ", "))


def contains_any(column: str, products: Sequence[str], mode: str = "exact") -> Column:
    """Whether a comma list holds any of ``products``, ignoring case.

    ``exact`` compares whole items. ``regex`` searches each product as a pattern anywhere in the
    text, so brackets in a name are groups and a short name also hits longer ones.
    """
    if mode == "exact":
        wanted = F.array(*[F.lit(p.lower()) for p in products])
        found = F.arrays_overlap(F.transform(split_list(column), F.lower), wanted)
    elif mode == "regex":
        found = F.lit(False)
        for p in products:
            found = found | F.col(column).rlike("(?i)" + p)
    else:
        raise ValueError(f"mode must be exact or regex, not {mode}")
    return F.coalesce(found, F.lit(False))


def category_label(text: Column, suffix: str) -> Column:
    """``home_decor_spend`` -> ``Home Decor``."""
    return F.initcap(F.replace(F.replace(text, F.lit(suffix), F.lit("")), F.lit("_"), F.lit(" ")))
