"""Functions over tables held as a header ARRAY<STRING> and rows ARRAY<ARRAY<STRING>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = r"^\s*:?[-:]+:?\s*$"


def _blank(cell: Column) -> Column:
    return F.trim(F.coalesce(cell, F.lit(""))) == ""


def is_placeholder(cell: Column, compat: bool = False) -> Column:
    """Blank, ``nan``, or made of quotes, spaces, colons and dashes only; null too, but for compat."""
    own = (F.lower(F.trim(cell)) == "nan") | (F.translate(cell, "\" :-", "") == "")
    return F.coalesce(own, F.lit(not compat))


def drop_index_rows(rows: Column) -> Column:
    """Without blank rows, rows that count 0..n or 1..n, and then an all-digit first row."""

    def counting(r: Column) -> Column:
        numbers = F.transform(r, lambda c: F.trim(c).try_cast("int"))
        steps = F.transform(numbers, lambda x, i: x - i)
        return (F.size(r) >= 2) & F.forall(numbers, lambda x: x.isNotNull()) & (F.size(F.array_distinct(steps)) == 1) & F.get(steps, F.lit(0)).isin(0, 1)

    kept = F.filter(rows, lambda r: ~F.forall(r, _blank) & ~F.coalesce(counting(r), F.lit(False)))
    digits = F.forall(F.get(kept, F.lit(0)), lambda c: F.trim(c).rlike("^[0-9]+$"))
    return F.when((F.size(kept) > 0) & digits, F.slice(kept, F.lit(2), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)


def without_separators(rows: Column) -> Column:
    """Without blank rows and rows whose filled cells all are Markdown separators."""
    return F.filter(rows, lambda r: ~F.forall(r, lambda c: _blank(c) | F.trim(c).rlike(SEPARATOR)))


def cleaned(rows: Column) -> Column:
    """White-space cells made empty, blank rows and blank columns dropped."""
    tidy = F.transform(F.filter(rows, lambda r: ~F.forall(r, _blank)), lambda r: F.transform(r, lambda c: F.when(_blank(c), "").otherwise(c)))
    width = F.coalesce(F.array_max(F.transform(tidy, lambda r: F.size(r))), F.lit(0))
    filled = F.filter(F.sequence(F.lit(0), F.greatest(width - 1, F.lit(0))), lambda i: F.exists(tidy, lambda r: ~_blank(F.get(r, i))))
    return F.transform(tidy, lambda r: F.transform(filled, lambda i: F.coalesce(F.get(r, i), F.lit(""))))


def signature(markdown: Column) -> Column:
    """Lines without separators, spaces and bars evened out, joined: alike for alike tables."""
    lines = F.filter(F.split(F.trim(markdown), "\n"), lambda x: ~x.rlike(r"^[\s|:-]+$"))
    return F.array_join(F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"\s*\|\s*", "|"), r"\s+", " "))), "||")


def content_hash(header: Column, rows: Column) -> Column:
    return F.sha2(F.to_json(F.struct(header.alias("header"), rows.alias("rows"))), 256)


def padded(rows: Column) -> Column:
    """Ragged rows filled up with empty cells."""
    width = F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))


def transposed(header: Column, rows: Column) -> Column:
    """The header as first row, then rows and columns exchanged."""
    grid = padded(F.concat(F.array(header), rows))
    width = F.size(F.get(grid, F.lit(0)))
    return F.when(width > 0, F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform(grid, lambda r: F.get(r, i)))).otherwise(F.array().cast("array<array<string>>"))


def named_cells(header: Column, rows: Column) -> Column:
    """Every cell as ``header-cell``; a missing or blank header is col{i}."""
    return F.transform(rows, lambda r: F.transform(r, lambda c, i: F.concat(F.coalesce(F.nullif(F.trim(F.get(header, i)), F.lit("")), F.concat(F.lit("col"), i.cast("string"))), F.lit("-"), F.coalesce(c, F.lit("")))))


def named_cells_transposed(header: Column, rows: Column) -> Column:
    grid = padded(named_cells(header, rows))
    return F.transform(F.sequence(F.lit(0), F.size(header) - 1), lambda i: F.concat(F.array(F.get(header, i)), F.transform(grid, lambda r: F.get(r, i))))


def row_count(rows: Column) -> Column:
    return F.size(F.coalesce(rows, F.array().cast("array<array<string>>")))


def to_text(header: Column, rows: Column, with_header: bool = True) -> Column:
    """Header and rows, cells joined by commas; without the header, joined by spaces."""
    if with_header:
        grid = F.concat(F.array(header), rows)
        return F.translate(F.array_join(F.transform(grid, lambda r: F.array_join(r, ",", "")), ","), "\t", " ")
    return F.array_join(F.transform(rows, lambda r: F.array_join(r, " ", "")), " ")


def joined_labels(labels: Column, separator: str = "; ") -> Column:
    return F.array_join(F.transform(F.split(labels, ","), lambda x: F.trim(x)), separator)


def qc_status(header: Column, rows: Column, one_row_allowed: Column) -> Column:
    """The first that holds of error, zero_col, zero_row, empty_after_clean, one_row, valid."""
    known = F.filter(rows, lambda r: ~F.forall(r, lambda c: F.coalesce(F.trim(c), F.lit("")) == ""))
    real = F.filter(known, lambda r: ~F.forall(r, lambda c: is_placeholder(c)))
    return (
        F.when(header.isNull() | rows.isNull(), "error").when(F.size(header) == 0, "zero_col").when(F.size(known) == 0, "zero_row").when(F.size(real) == 0, "empty_after_clean")
        .when((F.size(real) == 1) & ~one_row_allowed, "one_row").otherwise("valid")
    )
