"""Engagement columns and the small arithmetic the analyses share."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

METRICS = ("likes", "shares", "comments")


def engagement() -> Column:
    """Total of the three counts, a missing one adding nothing."""
    return sum((F.coalesce(F.col(m), F.lit(0)) for m in METRICS[1:]), F.coalesce(F.col("likes"), F.lit(0)))


def engagement_or_null() -> Column:
    """Same total, but NULL where not one count is known."""
    return F.when(F.coalesce(*map(F.col, METRICS)).isNotNull(), engagement())


def amplify_ratio() -> Column:
    """(shares + comments) per like; undefined without likes."""
    spread = F.coalesce(F.col("shares"), F.lit(0)) + F.coalesce(F.col("comments"), F.lit(0))
    return F.when(F.col("likes") > 0, spread.cast("double") / F.col("likes"))


def partial_metrics() -> Column:
    """1 when at least one of the three counts is missing."""
    gaps = F.greatest(*[F.col(m).isNull().cast("int") for m in METRICS])
    return gaps.cast("long")


def ratio(top: Column, bottom: Column) -> Column:
    """Double division that yields NULL on a zero divisor."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent(top: Column, bottom: Column) -> Column:
    return F.try_divide(100.0 * top.cast("double"), bottom.cast("double"))


def count_where(condition: Column) -> Column:
    """Rows satisfying ``condition``; NULL counts as no, and an empty input gives 0."""
    return F.count_if(condition)


def long(column: Column) -> Column:
    return column.cast("long")
