"""Inline loan rows for unit tests: missing columns are NULL."""
import datetime as dt
from decimal import Decimal

from loanlens.sources.schema import LOAN_COLUMNS, LOAN_SCHEMA
from pyspark.sql import types as T


def _coerce(v, t):
    if v is None:
        return None
    if isinstance(t, T.DecimalType):
        return Decimal(str(v))
    if isinstance(t, T.DateType) and isinstance(v, str):
        return dt.date.fromisoformat(v)
    return v


def make_loans(spark, rows):
    data = [tuple(_coerce(r.get(n), t) for n, t in LOAN_COLUMNS) for r in rows]
    return spark.createDataFrame(data, LOAN_SCHEMA)


def digest(df):
    """Order-insensitive exact multiset of rows (columns sorted by name)."""
    from collections import Counter

    from verify import _norm
    cols = sorted(df.columns)
    return Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
