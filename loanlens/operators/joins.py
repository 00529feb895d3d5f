"""Joins on an interval: a point in time against intervals, without a cross join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _number(column: Column, kind: T.DataType) -> Column:
    """Times as microseconds, dates as days, whole numbers as they are."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.to_utc_timestamp(column, "UTC"))
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    if isinstance(kind, T.IntegralType):
        return column.cast("long")
    raise TypeError(f"an interval join needs times, dates or whole numbers, not {kind.simpleString()}")


def interval_join(left: DataFrame, right: DataFrame, *, at: str, start: str, end: str, by: Sequence[str] = (), how: str = "inner",
                  prefix: str = "right_", closed: bool = False) -> DataFrame:
    """Pairs with ``start <= at < end`` (``closed``: ``<= end``) and equal ``by`` columns.

    Every interval has a level, the smallest whose buckets (2 ** level wide) are as wide as it, so it touches two buckets at most,
    however long it is. A point is looked up in its bucket of each level that occurs (64 at most, one small job finds them).
    Pairs meet in one bucket only. It is an equi-join on ``by``, level and bucket, which Spark shuffles, and splits where a bucket
    is hot. ``how``: "inner" or "left". Null times, null keys and empty intervals meet nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    kinds = {left.schema[at].dataType, right.schema[start].dataType, right.schema[end].dataType}
    if len(kinds) > 1:
        raise TypeError("the point and both ends of the interval need one type")
    kind = kinds.pop()
    named = [f"__by{i}" for i in range(len(by))]
    keys = [F.col(k).alias(n) for k, n in zip(by, named)]

    r = right.select(*keys, F.struct(*right.columns).alias("__right"), _number(F.col(start), kind).alias("__start"),
                     (_number(F.col(end), kind) + int(closed)).alias("__end")).where("__end > __start")
    # bits of (length - 1): the smallest power of two that holds the interval
    length = F.col("__end") - F.col("__start")
    r = r.withColumn("__level", F.when(length == 1, 0).otherwise(F.length(F.bin(length - 1))).cast("int"))
    levels = sorted(x[0] for x in r.select("__level").distinct().collect())
    bucket = lambda x: F.call_function("shiftright", x, F.col("__level"))
    r = r.withColumn("__bucket", F.explode(F.sequence(bucket(F.col("__start")), bucket(F.col("__end") - 1))))

    x = left.select(*keys, F.struct(*left.columns).alias("__left"), _number(F.col(at), kind).alias("__at"))
    if how == "left":
        x = x.withColumn("__id", F.monotonically_increasing_id())
    points = x.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__bucket", bucket(F.col("__at")))
    pairs = points.join(r, [*named, "__level", "__bucket"]).where((F.col("__start") <= F.col("__at")) & (F.col("__at") < F.col("__end")))
    out = [F.col("__left")[c].alias(c) for c in left.columns] + [F.col("__right")[c].alias(prefix + c) for c in right.columns]
    if how == "inner":
        return pairs.select(*out)
    return x.join(pairs.select("__id", "__right"), "__id", "left").select(*out)
