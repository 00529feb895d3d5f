"""All registered analyses: name -> (DataFrame function, oracle SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loanlens.plans import extended, generic, statements, streams, tier1, tier2, tier3, tier4
from loanlens.sources.loans import loans

_TIERS = [tier1, tier2, tier3, tier4]


def loan_functions() -> dict[str, Callable[[DataFrame], DataFrame]]:
    out = {}
    for t in _TIERS:
        out.update(t.FUNCS)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """``name -> (spark, sf_dir) -> DataFrame`` for every analysis."""
    out = {}
    for name, fn in loan_functions().items():
        out[name] = (lambda f: lambda spark, sf_dir: f(loans(spark, sf_dir)))(fn)
    out.update(generic.FUNCS)
    out.update(extended.FUNCS)
    out.update(streams.FUNCS)
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for t in (tier1, tier2, tier3, statements):
        out.update(t.SQL)
    out.update(generic.SQL)
    out.update(extended.SQL)
    out.update(streams.SQL)
    return out
