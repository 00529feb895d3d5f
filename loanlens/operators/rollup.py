"""Two-level aggregation, time cohorts and windowed baselines (G5, G6, G14)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions.canon import c, iavg_over
from loanlens.functions.collation import grouped


def entity_rollup(df: DataFrame, entity: str, inner: Mapping[str, Column],
                  outer_keys: Sequence, outer: Mapping[str, Column],
                  where: Column | None = None, having: Column | None = None) -> DataFrame:
    """loan -> entity -> segment: aggregate per entity, then per segment of entities.

    The first ``groupBy(entity)`` is a high-cardinality shuffle with partial
    aggregation (a borrower with a third of all loans collapses to one
    partial row per map task). Its output is one row per entity, so the
    second aggregation's input is already much smaller; ``outer_keys`` may
    be inner measure names or Columns over them.
    """
    if where is not None:
        df = df.filter(where)
    per_entity = grouped(df, entity).agg(*[m.alias(k) for k, m in inner.items()])
    out = grouped(per_entity, *outer_keys).agg(*[m.alias(k) for k, m in outer.items()])
    if having is not None:
        out = out.filter(having)
    return out


def cohort_columns(df: DataFrame, ts, grains: Sequence[str] = ("year",),
                   names: Mapping[str, str] | None = None) -> DataFrame:
    """Add calendar cohort columns (year / quarter / month) of a date column."""
    fns = {"year": F.year, "quarter": F.quarter, "month": F.month}
    names = names or {}
    for g in grains:
        df = df.withColumn(names.get(g, g), fns[g](c(ts)))
    return df


def cohort_trend(df: DataFrame, ts, grains: Sequence[str], measures: Mapping[str, Column],
                 names: Mapping[str, str] | None = None, where: Column | None = None) -> DataFrame:
    """Group by calendar cohorts of ``ts`` and compute ``measures``."""
    if where is not None:
        df = df.filter(where)
    df = cohort_columns(df, ts, grains, names)
    keys = [(names or {}).get(g, g) for g in grains]
    return grouped(df, *keys).agg(*[m.alias(k) for k, m in measures.items()])


def windowed_baseline(df: DataFrame, partition: str, measure: str, out: str) -> DataFrame:
    """Integer ``AVG(measure) OVER (PARTITION BY partition)`` (T-SQL truncation)."""
    return df.withColumn(out, iavg_over(measure, Window.partitionBy(partition)))
