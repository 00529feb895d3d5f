"""Row scoring: additive factor scores, rule labels, scenarios (G9, G10, G11)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanlens.functions.buckets import bucketize


def additive_score(df: DataFrame, factors: Mapping[str, tuple], score_col: str) -> DataFrame:
    """Add one points column per ``name: (input, ladder)`` and their sum.

    Pure projection (no shuffle); the sum is computed once and reused.
    """
    for name, (x, ladder) in factors.items():
        df = df.withColumn(name, bucketize(x, ladder))
    total = None
    for name in factors:
        total = F.col(name) if total is None else total + F.col(name)
    return df.withColumn(score_col, total)


def rule_label(rules: Sequence[tuple[Column, str]], default: str) -> Column:
    """First matching ``(predicate, label)`` wins; else ``default``."""
    out = None
    for pred, label in rules:
        out = F.when(pred, F.lit(label)) if out is None else out.when(pred, F.lit(label))
    return out.otherwise(F.lit(default))


def scenario_grid(one_row: DataFrame, scenarios: Sequence[tuple[str, str | None]],
                  label_col: str = "scenario", mult_col: str = "multiplier") -> DataFrame:
    """Cross a one-row metrics frame with a fixed list of ``(label, multiplier)``.

    Done as a projection: the scenario list is a literal array exploded on
    the single row, so there is no join and no second scan of the input.
    A ``None`` multiplier marks the baseline row.
    """
    items = [F.struct(F.lit(label).alias(label_col),
                      (F.lit(Decimal(m)) if m is not None else F.lit(None).cast("decimal(3,2)"))
                      .cast("decimal(3,2)").alias(mult_col))
             for label, m in scenarios]
    return (one_row.withColumn("_sc", F.explode(F.array(*items)))
            .select("*", F.col(f"_sc.{label_col}").alias(label_col),
                    F.col(f"_sc.{mult_col}").alias(mult_col))
            .drop("_sc"))


__all__ = ["additive_score", "rule_label", "scenario_grid"]
