"""Predicates of the lake as columns, for any table that has the columns they read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

#: Cards that stand for none.
NO_CARD = ("None", "none", "Null", "null", "N/A", "n/a", "Entry not found")
INVALID_USER = "Invalid username or password."


def valid_card(card: Column) -> Column:
    return F.coalesce((card != "") & (card != NO_CARD[-1]), F.lit(False))


def strictly_valid_card(card: Column, least: int = 10) -> Column:
    """Neither blank nor a word for none, longer than ``least`` characters, and no login error."""
    own = F.trim(card)
    return F.coalesce((own != "") & ~own.isin(*NO_CARD) & (F.length(card) > least) & (card != INVALID_USER), F.lit(False))


def empty_pattern(card: Column) -> Column:
    """null, empty, na, not_found or other."""
    return F.when(card.isNull(), "null").when(card == "", "empty").when(F.trim(card) == "N/A", "na").when(card == NO_CARD[-1], "not_found").otherwise("other")


def has_any(*lists: Column) -> Column:
    """Whether any list has an element; null lists have none."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.size(x), F.lit(0)) > 0 for x in lists])


def only_in(first: Column, *others: Column) -> Column:
    return has_any(first) & ~has_any(*others)


def within_size(n_rows: Column, n_cols: Column, rows: int = 200, cols: int = 100) -> Column:
    return ~((n_cols >= cols) | (n_rows >= rows))


def template_score(text: Column, *parts: str) -> Column:
    """How many of the parts a text holds; 0 for a null text."""
    return reduce(lambda a, b: a + b, [F.coalesce(text.contains(p).cast("int"), F.lit(0)) for p in parts])


def list_match(df: DataFrame, column: str, *values: str) -> Column:
    """A list that holds a value, or an element that ends in it whatever the case; a single value likewise."""
    def ends(value: str):
        return lambda e: F.lower(e.cast("string")).endswith(value.lower())

    if isinstance(df.schema[column].dataType, ArrayType):
        found = [F.array_contains(F.transform(column, lambda e: e.cast("string")), v) | F.exists(column, ends(v)) for v in values]
    else:
        found = [ends(v)(F.col(column)) for v in values]
    return F.coalesce(reduce(lambda a, b: a | b, found), F.lit(False))
