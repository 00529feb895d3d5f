"""Ranks over aggregated segments, concentration curves (G7, G8)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions.buckets import Ladder, bucketize


def multi_rank(df: DataFrame, ranks: Mapping[str, Sequence[Column]]) -> DataFrame:
    """Add one ``RANK() OVER (ORDER BY ...)`` column per entry.

    Un-partitioned windows run in a single task: apply only to aggregated
    input (one row per segment), never to raw loans.
    """
    for name, order in ranks.items():
        df = df.withColumn(name, F.rank().over(Window.orderBy(*order)))
    return df


def row_number_by(df: DataFrame, name: str, order: Sequence[Column]) -> DataFrame:
    """``ROW_NUMBER() OVER (ORDER BY ...)``; pass a unique tie-breaker last so the
    numbering is deterministic."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def concentration_curve(df: DataFrame, rank_col: str, order: Sequence[Column],
                        share_col: str, cumulative_col: str,
                        tier_col: str | None = None, tiers: Ladder | None = None) -> DataFrame:
    """Rank segments, running total of their (rounded) shares, tier labels.

    ``SUM(share) OVER (ORDER BY rank)`` uses the default RANGE frame, so
    equal ranks would share a total; ``row_number`` ranks are unique.
    """
    df = row_number_by(df, rank_col, order)
    running = Window.orderBy(rank_col).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn(cumulative_col, F.sum(share_col).over(running))
    if tier_col and tiers:
        df = df.withColumn(tier_col, bucketize(rank_col, tiers))
    return df
