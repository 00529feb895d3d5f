"""Grouped profiles and shares (operators G3, G4, G13)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions.canon import c, n_rows, pct
from loanlens.functions.collation import grouped


def segment_profile(df: DataFrame, keys: Sequence, measures: Mapping[str, Column],
                    count_name: str = "n", min_count: int | None = None,
                    where: Column | None = None) -> DataFrame:
    """Filter -> group -> count + measures -> keep groups with ``n >= min_count``.

    ``keys`` are column names or named Columns (computed bucket labels are
    grouped by alias, never recomputed). One shuffle on the keys, with
    partial aggregation before it, so a hot key costs one pre-aggregated row
    per map task.
    """
    if where is not None:
        df = df.filter(where)
    aggs = [n_rows().alias(count_name)] + [m.alias(k) for k, m in measures.items()]
    out = grouped(df, *keys).agg(*aggs)
    if min_count is not None:
        out = out.filter(F.col(count_name) >= min_count)
    return out


def profile_with_total(df: DataFrame, keys: Sequence, keep: Column,
                       measures: Mapping[str, Column],
                       totals: Mapping[str, Column | str],
                       count_name: str = "n") -> DataFrame:
    """Group the rows selected by ``keep`` and attach totals over **all** rows.

    Equivalent to ``GROUP BY keys WHERE keep`` plus an uncorrelated
    ``(SELECT SUM(x) FROM whole_table)``, in one scan: rows failing ``keep``
    form their own group (key ``_keep = false``), the totals are summed over
    every group with an empty window (a few rows after aggregation), and the
    extra group is dropped. ``totals`` maps an output name to the per-group
    column to sum (``count_name`` or a measure name).
    """
    flagged = df.withColumn("_keep", F.coalesce(keep, F.lit(False)))
    g = grouped(flagged, F.col("_keep"), *keys).agg(
        n_rows().alias(count_name), *[m.alias(k) for k, m in measures.items()])
    everything = Window.partitionBy()
    for name, src in totals.items():
        g = g.withColumn(name, F.sum(c(src)).over(everything))
    return g.filter(F.col("_keep")).drop("_keep")


def share_of_groups(df: DataFrame, count_col: str, out: str, d: int = 2) -> DataFrame:
    """``ROUND(n * 100.0 / SUM(n) OVER (), d)``: share among the result groups.

    The empty window runs in one task, which is only acceptable because its
    input is already aggregated to a bounded number of groups.
    """
    total = F.sum(count_col).over(Window.partitionBy())
    return df.withColumn(out, pct(F.col(count_col), total, d))


def calibration(df: DataFrame, key: str, expected: Mapping[str, Column],
                realized: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """Expected (model) versus realized outcome averages per segment."""
    if where is not None:
        df = df.filter(where)
    return grouped(df, key).agg(*[m.alias(k) for k, m in {**expected, **realized}.items()])


__all__ = ["segment_profile", "profile_with_total", "share_of_groups", "calibration"]
