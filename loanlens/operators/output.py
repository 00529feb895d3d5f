"""Final ordering of a bounded result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def sorted_result(df: DataFrame, *order) -> DataFrame:
    """``ORDER BY`` for a result with one row per segment.

    A global ``orderBy`` range-partitions its input, which costs a sampling
    job to find the bounds; a result whose size is bounded by the number of
    segments (bands, statuses, states, cells) is sorted in one task instead.
    The exchange stands above the final aggregation, which stays parallel: the
    task gets one row per segment. Never use it for row-level outputs.
    """
    return df.repartition(1).sortWithinPartitions(*order)


def sorted_by(*order) -> Callable[[DataFrame], DataFrame]:
    """``df.transform(sorted_by(...))`` form of :func:`sorted_result`."""
    return lambda df: sorted_result(df, *order)
