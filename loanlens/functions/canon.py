"""Canonical numeric and date forms shared by every analysis.

The analyses come from T-SQL, whose averages, decimal scales and rounding
differ from both Spark's and DuckDB's defaults. Each helper fixes one form
that gives bit-identical results in Spark and in the DuckDB oracle; the
matching SQL text is produced by ``loanlens.plans.sqlkit``.

* ``avg_x``   exact average: sum of an exact (decimal / integer) column,
              as double, divided by the non-NULL count.
* ``iavg``    T-SQL ``AVG`` of an integer expression: integer division of sum
              and count, truncating, as bigint.
* ``exact_round`` a quotient of exact numbers (counts, decimal sums), divided
              once in integer arithmetic and rounded once, half away from
              zero. ``pct``, ``ravg`` and the ratios of averages use it.
* ``quantize6`` fixes a double at six decimals with IEEE operations only
              (``floor(x * 1e6 + 0.5)`` micro-units), so every engine gets
              the same digits; a plain double->decimal cast does not (Spark
              rounds the shortest decimal string, DuckDB the binary value).
* ``rnd``     ``ROUND(x, d)`` of a double: ``quantize6`` then decimal
              half-away-from-zero rounding.
* ``ratio6``  a row-level ratio or an inner average, quantized before it
              is averaged again (summing doubles depends on row order).
"""

from __future__ import annotations

import datetime as _dt
from decimal import Decimal

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.functions.buckets import BAD_STATUSES, PAST_DUE_PREFIX

PRE_ROUND = T.DecimalType(28, 6)


def D(p: int, s: int) -> T.DecimalType:
    return T.DecimalType(p, s)


def dec(v: str | int) -> Column:
    """Exact decimal literal (``F.lit(0.2)`` would be a double)."""
    return F.lit(Decimal(str(v)))


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- predicates and flags ---------------------------------------------------

def is_bad(status="loan_status") -> Column:
    return c(status).isin(*BAD_STATUSES)


def is_status(value: str, status="loan_status") -> Column:
    return c(status) == value


def is_past_due(status="loan_status") -> Column:
    return c(status).startswith(PAST_DUE_PREFIX)


def flag(pred: Column) -> Column:
    """1/0 integer flag; a NULL predicate counts as 0 (CASE ... ELSE 0)."""
    return F.when(pred, F.lit(1)).otherwise(F.lit(0))


def count_if(pred: Column) -> Column:
    """``SUM(CASE WHEN pred THEN 1 ELSE 0 END)`` as bigint."""
    return F.sum(flag(pred)).cast("bigint")


def n_rows() -> Column:
    return F.count(F.lit(1))


# --- averages ---------------------------------------------------------------

def avg_x(x) -> Column:
    """Exact average of a decimal or integer expression, as double."""
    x = c(x)
    return F.try_divide(F.sum(x).cast("double"), F.count(x))


def _div(a: Column, b: Column) -> Column:
    """Integer quotient as bigint, truncated toward zero; NULL when b is 0."""
    return F.when(b != 0, F.call_function("div", a, F.when(b != 0, b)))


def iavg(x) -> Column:
    """T-SQL integer ``AVG``: truncates toward zero, as bigint."""
    x = c(x)
    return _div(F.sum(x), F.count(x))


def iavg_over(x, w: Window) -> Column:
    """Integer ``AVG(x) OVER (w)``."""
    x = c(x)
    return _div(F.sum(x).over(w), F.count(x).over(w))


def quantize6(x) -> Column:
    """Double -> decimal(28,6) via micro-units: identical in every IEEE engine."""
    units = F.floor(to_double(x) * F.lit(1e6) + F.lit(0.5))
    return (units.cast(D(20, 0)) * dec("0.000001")).cast(PRE_ROUND)


def ratio6(x) -> Column:
    """Fix a row-level ratio / inner average before it is averaged again."""
    return quantize6(x)


# --- rounding and percentages -------------------------------------------------

def rnd(x, d: int, p: int = 18) -> Column:
    """Half-away-from-zero ``ROUND(x, d)`` of a double, as decimal(p, d)."""
    return F.round(quantize6(x), d).try_cast(D(p, d))


def to_double(x) -> Column:
    return c(x).cast("double")


def exact_round(num, den, d: int, p: int = 18) -> Column:
    """``ROUND(num / den, d)`` of exact numbers, half away from zero; NULL when ``den`` is 0.

    Both are integers or decimals of scale 6 at most, ``den`` is not negative.
    """
    num, den = c(num), c(den)
    twice = _div(F.abs(num) * F.lit(2 * 10 ** d).cast(D(10, 0)) + den, den * F.lit(2).cast(D(1, 0)))
    units = F.when(num < 0, -twice).otherwise(twice)
    return (units.cast(D(20, 0)) * dec(Decimal(1).scaleb(-d).to_eng_string() if d else 1)).cast(D(p, d))


def _exact(x: Column) -> Column:
    return x.cast(D(20, 0))


def pct(num, den, d: int = 2, p: int = 18, times: int = 100) -> Column:
    """Rounded percentage of exact numbers, ``decimal(p, d)``."""
    return exact_round(c(num) * F.lit(times).cast(D(10, 0)), den, d, p)


def ravg(x, d: int, times: int = 1) -> Column:
    """``ROUND(AVG(x) * times, d)`` of an exact expression: one division, one rounding."""
    x = c(x)
    return exact_round(F.sum(x) * F.lit(times).cast(D(10, 0)), F.count(x), d)


def ravg_ratio(x, y, d: int, times: int = 100, per: int = 1) -> Column:
    """``ROUND(AVG(x) * times / (AVG(y) * per), d)`` of exact expressions."""
    x, y = c(x), c(y)
    top = F.sum(x) * _exact(F.count(y)) * F.lit(times).cast(D(10, 0))
    return exact_round(top, F.sum(y) * _exact(F.count(x)) * F.lit(per).cast(D(5, 0)), d)


def ravg_diff(x, y, d: int, times: int = 1) -> Column:
    """``ROUND((AVG(x) - AVG(y)) * times, d)`` of exact expressions."""
    x, y = c(x), c(y)
    nx, ny = _exact(F.count(x)), _exact(F.count(y))
    return exact_round((F.sum(x) * ny - F.sum(y) * nx) * F.lit(times).cast(D(10, 0)), nx * ny, d)


def bad_pct() -> Column:
    """Share of bad loans among the group's rows, in percent."""
    return pct(count_if(is_bad()), n_rows())


def flag_rate(pred: Column) -> Column:
    """``AVG(CASE WHEN pred THEN 1.0 ELSE 0 END)`` as double."""
    return avg_x(flag(pred))


def nullif0(x) -> Column:
    x = c(x)
    return F.when(x != 0, x)


def guarded_div(a, b) -> Column:
    """``a / NULLIF(b, 0)`` on doubles."""
    return F.try_divide(to_double(a), nullif0(to_double(b)))


# --- money text -------------------------------------------------------------

def currency(x) -> Column:
    """``FORMAT(x, 'C', 'en-US')``: ``$1,234.50``, negative amounts ``-$1,234.50``.

    ``x`` must already be a decimal with two places (exact sums), or pass a
    double through ``rnd(x, 2)`` first.
    """
    x = c(x)
    return F.concat(F.when(x < 0, F.lit("-$")).otherwise(F.lit("$")), F.format_number(F.abs(x), 2))


# --- dates ------------------------------------------------------------------

def safe_timestamp(x) -> Column:
    """``TRY_CONVERT(DATETIME, x)``: NULL for text that is not a date."""
    return c(x).try_cast("timestamp")


def month_boundaries(start, end) -> Column:
    """``DATEDIFF(MONTH, start, end)``: month boundaries crossed (not whole months)."""
    start, end = c(start), c(end)
    return (F.year(end) - F.year(start)) * 12 + (F.month(end) - F.month(start))


def day_diff(start, end) -> Column:
    """``DATEDIFF(DAY, start, end)``, may be negative."""
    return F.datediff(c(end), c(start))


def as_of_literal(as_of: _dt.date | str) -> Column:
    """A fixed 'now' for open loans: never the wall clock."""
    if isinstance(as_of, str):
        as_of = _dt.date.fromisoformat(as_of)
    return F.lit(as_of).cast("timestamp")
