"""Numeric column functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def rounded(x: str | Column, places: int) -> Column:
    """A double rounded by its exact binary value, ties to even: 1.025 is below the middle and gives 1.02. NaN, infinities and 0 stay, -0 is 0."""
    x = F.col(x) if isinstance(x, str) else x
    x = x.cast("double")
    return F.when(F.abs(x) < 1e15, F.translate(F.format_number(x, places), ",", "").cast("double") + F.lit(0.0)).otherwise(x)


def exact_sum(column: str | Column, places: int = 2) -> Column:
    """A sum in decimals of so many places: the same in whatever order the rows come."""
    return F.sum(F.col(column).cast(f"decimal(18,{places})") if isinstance(column, str) else column.cast(f"decimal(18,{places})"))


def sorted_median(a: Column) -> Column:
    """Of an ascending array; null if it is empty."""
    n = F.size(a)
    return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)


def exclusive_quartile(a: Column, i: int) -> Column:
    """Quartile i of an ascending array by the exclusive method (place i * (n + 1) / 4); null below two values."""
    n = F.size(a)
    j = F.greatest(F.lit(1), F.least(n - 1, F.floor(F.lit(i) * (n + 1) / 4).cast("int")))
    d = F.lit(i) * (n + 1) - 4 * j
    return F.when(n >= 2, (F.get(a, j - 1) * (4 - d) + F.get(a, j) * d) / 4.0)


def quartile_range(a: Column) -> Column:
    """The scale of an ascending array by its quartiles: their range over 1.349, 0 at least."""
    return F.greatest((exclusive_quartile(a, 3) - exclusive_quartile(a, 1)) / 1.349, F.lit(0.0))


def z_score(x: Column, median: Column, scale: Column) -> Column:
    """(x - median) / scale, 2 places; null where the scale is 0 or null."""
    return rounded((x - median) / F.nullif(scale, F.lit(0.0)), 2)
