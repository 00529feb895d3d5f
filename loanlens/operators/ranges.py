"""Windows, as-of joins and running values over raw rows, dealt into ranges.

``F.sum(x).over(Window.orderBy(t))`` brings all rows to one task, and with a
partition key a hot key's rows. Here rows are dealt into ranges of their order, so a
hot key (or none at all) is spread over as many tasks as it has ranges:

1. ``ranged`` range-partitions the rows by key and order, numbers the ranges, and
   stores them, so that numbers and rows stay together when an executor is lost;
2. each range and key gives partial results (count, sums, last row ...): one row a
   key, and one more for each range that a key goes on in;
3. running results of the partials, by key in the order of ranges, are what a range
   must add to its own: the *header* of a range and key;
4. headers are put before the rows of their range, and one window for each range and
   key gives every row its result. The largest window is a range, whatever the keys.

Rows are shuffled twice (into ranges, to the windows), headers once more.

Order columns must make rows of a key distinct (end with a unique column), else the
order of equal rows is not defined, as in SQL. Nulls come first, as in Spark.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.session import checkpoint_dir

RANGE, HEAD = "__range", "__head"


def ranged(df: DataFrame, order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``df`` with ``__range``: rows of a smaller range come before those of a larger one in ``order``.

    ``ranges``: at most so many; else the session's number of shuffle partitions, which AQE lowers for little data.
    """
    checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(*([ranges] if ranges else []), *order).withColumn(RANGE, F.spark_partition_id()).checkpoint(eager=True)


def _under_headers(rows: DataFrame, headers: DataFrame) -> DataFrame:
    return (rows.withColumn(HEAD, F.lit(1))
            .unionByName(headers.withColumn(HEAD, F.lit(0)), allowMissingColumns=True))


def _nth_from_end(values: str, back: Column) -> Column:
    """Element ``back`` (1: the last) of an array, null where there is none."""
    return F.when((back >= 1) & (back <= F.size(values)), F.get(values, F.size(values) - back))


def _field(name: str) -> Callable[[Column], Column]:
    return lambda x: x[name]


def _added(kind: T.DataType) -> Callable[[Column, Column], Column]:
    return lambda s, x: (s + x).cast(kind)


def windows(df: DataFrame, order: Sequence[str], partition: Sequence[str] = (), *, row_number: str | None = None,
            ntile: Mapping[str, int] | None = None, dense_rank: str | None = None, running_sum: Mapping[str, str] | None = None,
            moving_sum: Mapping[str, tuple[str, int]] | None = None, lag: Mapping[str, tuple[str, int]] | None = None,
            lead: Mapping[str, tuple[str, int]] | None = None, first_value: Mapping[str, str] | None = None,
            last_value: Mapping[str, str] | None = None, ranges: int | None = None) -> DataFrame:
    """``df`` with window results over ``PARTITION BY partition ORDER BY order`` (ascending).

    Each argument names result columns: ``row_number`` and ``dense_rank`` (of the first order column) one, the others map a name to
    its column: ``ntile`` {name: buckets}; ``running_sum`` {name: column}; ``moving_sum`` {name: (column, rows before)}, frame from so
    many rows before to the current row; ``lag`` and ``lead`` {name: (column, rows)}; ``first_value`` and ``last_value`` of the whole
    partition {name: column}.

    Sums of integers and decimals are exact; of doubles they depend on the dealing in their last digits.
    """
    ntile, running_sum, moving_sum = ntile or {}, running_sum or {}, moving_sum or {}
    lag, lead, first_value, last_value = lag or {}, lead or {}, first_value or {}, last_value or {}
    keys = list(partition)
    rows = ranged(df, [*keys, *order], ranges)

    place = F.struct(*order)
    states = {"__n": F.count(F.lit(1))}
    states |= {f"__sum_{c}": F.sum(c) for c in running_sum.values()}
    states |= {f"__first_{c}": F.min_by(F.struct(c), place) for c in first_value.values()}
    states |= {f"__last_{c}": F.max_by(F.struct(c), place) for c in last_value.values()}
    if dense_rank:
        value = F.struct(order[0])
        states |= {"__values": F.count_distinct(value), "__low": F.min(value), "__high": F.max(value)}
    headers = rows.groupBy(RANGE, *keys).agg(*(v.alias(k) for k, v in states.items()))

    by_range = Window.partitionBy(*keys).orderBy(RANGE)
    before = by_range.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_range.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = by_range.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    carried = {"__before": F.coalesce(F.sum("__n").over(before), F.lit(0)), "__own": F.col("__n"), "__all": F.sum("__n").over(everything)}
    carried |= {f"__upto_{c}": F.sum(f"__sum_{c}").over(before) for c in running_sum.values()}
    carried |= {f"__begin_{c}": F.first(f"__first_{c}").over(everything) for c in first_value.values()}
    carried |= {f"__end_{c}": F.last(f"__last_{c}").over(everything) for c in last_value.values()}
    if dense_rank:
        # a value that goes on from the range before has been counted there
        again = F.coalesce((F.lag("__high").over(by_range) == F.col("__low")).cast("long"), F.lit(0))
        headers = headers.withColumn("__again", again)
        carried["__ranks"] = F.coalesce(F.sum("__values").over(before), F.lit(0)) - F.sum("__again").over(upto)
    headers = headers.select(RANGE, *keys, *(v.alias(k) for k, v in carried.items()))

    for side, wanted, moved in (("__back", [*lag.values(), *moving_sum.values()], -1), ("__ahead", lead.values(), 1)):
        if wanted:
            headers = _with_edges(headers, rows, keys, order, side, {c for c, _ in wanted}, max(k for _, k in wanted), moved)

    own = Window.partitionBy(RANGE, *keys).orderBy(HEAD, *order)
    seen = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carry = [c for c in headers.columns if c not in (RANGE, *keys)]
    out = _under_headers(rows, headers).withColumns(
        {c: F.first(c).over(seen) for c in carry} | {"__at": F.row_number().over(own) - 1}
        | {f"__r_{n}": F.sum(c).over(seen) for n, c in running_sum.items()}
        | {f"__r_{n}": F.sum(c).over(own.rowsBetween(-k, Window.currentRow)) for n, (c, k) in moving_sum.items()}
        | {f"__r_{n}": F.lag(F.struct(c), k).over(own) for n, (c, k) in lag.items()}
        | {f"__r_{n}": F.lead(F.struct(c), k).over(own) for n, (c, k) in lead.items()}
        | ({"__rank": F.dense_rank().over(Window.partitionBy(RANGE, *keys).orderBy(HEAD, order[0])) - 1} if dense_rank else {}))

    at, number = F.col("__at"), F.col("__before") + F.col("__at")
    results: dict[str, Column] = {}
    if row_number:
        results[row_number] = number.cast("long")
    if dense_rank:
        results[dense_rank] = (F.col("__ranks") + F.col("__rank")).cast("long")
    for name, k in ntile.items():
        size, larger = F.expr(f"__all div {k}"), F.expr(f"__all % {k}")
        edge = larger * (size + 1)                                  # rows in the buckets that hold one more
        results[name] = F.when(number <= edge, F.call_function("div", number - 1, size + 1) + 1).otherwise(
            F.call_function("div", number - 1 - edge, F.greatest(size, F.lit(1))) + larger + 1).cast("long")
    for name, c in running_sum.items():
        results[name] = F.when(F.col(f"__upto_{c}").isNull(), F.col(f"__r_{name}")).otherwise(
            (F.col(f"__upto_{c}") + F.coalesce(F.col(f"__r_{name}"), F.lit(0))).cast(out.schema[f"__r_{name}"].dataType))
    for name, (c, k) in moving_sum.items():
        kind = out.schema[f"__r_{name}"].dataType
        # rows of the frame that lie before the range
        missing = F.slice(F.col("__back"), F.greatest(F.size("__back") - k + at, F.lit(1)), F.greatest(F.least(k + 1 - at, F.size("__back")), F.lit(0)))
        earlier = F.filter(F.transform(missing, _field(c)), lambda x: x.isNotNull())
        extra = F.when(F.size(earlier) > 0, F.aggregate(earlier, F.lit(0).cast(kind), _added(kind)))
        results[name] = F.when(extra.isNull(), F.col(f"__r_{name}")).otherwise((extra + F.coalesce(F.col(f"__r_{name}"), F.lit(0))).cast(kind))
    for name, (c, k) in lag.items():
        results[name] = F.when(at > k, F.col(f"__r_{name}")[c]).otherwise(_nth_from_end("__back", k - at + 1)[c])
    for name, (c, k) in lead.items():
        results[name] = F.when(at + k <= F.col("__own"), F.col(f"__r_{name}")[c]).otherwise(F.get("__ahead", at + k - F.col("__own") - 1)[c])
    results |= {name: F.col(f"__begin_{c}")[c] for name, c in first_value.items()}
    results |= {name: F.col(f"__end_{c}")[c] for name, c in last_value.items()}
    return out.where(F.col(HEAD) == 1).select(*df.columns, *(v.alias(k) for k, v in results.items()))


def _with_edges(headers: DataFrame, rows: DataFrame, keys: list[str], order: Sequence[str], name: str, columns: set[str], k: int,
                moved: int) -> DataFrame:
    """``headers`` with the ``k`` rows of the key before (moved -1) or behind (1) the range, in order.

    Each range and key gives its last (first) k rows, found by a group limit that works before the shuffle, too.
    """
    towards = [F.desc_nulls_last(c) if moved < 0 else F.asc_nulls_first(c) for c in order]
    near = (rows.select(RANGE, *keys, *order, *(c for c in sorted(columns) if c not in order and c not in keys))
            .withColumn("__nth", F.row_number().over(Window.partitionBy(RANGE, *keys).orderBy(*towards))).where(F.col("__nth") <= k))
    edge = near.groupBy(RANGE, *keys).agg(F.sort_array(F.collect_list(F.struct(
        (F.col("__nth") * moved).alias("__nth"), *sorted(columns)))).alias("__edge"))           # k at most
    both = headers.withColumn("__edge", F.lit(None).cast(edge.schema["__edge"].dataType)).unionByName(edge, allowMissingColumns=True)
    one = both.groupBy(RANGE, *keys).agg(*(F.first(c, ignorenulls=True).alias(c) for c in [*(x for x in headers.columns if x not in (RANGE, *keys)), "__edge"]))
    # every range of a key holds a row, so k of them hold k rows
    span = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(*((-k, -1) if moved < 0 else (1, k)))
    near_rows = F.flatten(F.collect_list("__edge").over(span))
    kept = F.slice(near_rows, F.greatest(F.size(near_rows) - k, F.lit(0)) + 1, k) if moved < 0 else F.slice(near_rows, 1, k)
    return one.withColumn(name, kept).drop("__edge")


def asof_join(left: DataFrame, right: DataFrame, *, left_time: str, right_time: str, by: Sequence[str] = (), prefix: str = "right_",
              tie: Sequence[str] = (), tolerance: Column | None = None, ranges: int | None = None) -> DataFrame:
    """Each row of ``left`` with the last row of ``right`` of the same ``by`` columns whose time is not later.

    Of right rows with one time the one that is largest by ``tie`` counts, then by all its columns. The right columns are named with
    ``prefix``, and null where there is no such row. ``tolerance``: how much older a right row may be, as an expression that is
    subtracted from the left time. Null keys and null times meet nothing.

    Both sides are put in one order and dealt into ranges; the last right row of a key is carried from one range into the next, so
    the events of a hot key are spread over its ranges, and no pair is made that is not in the result.
    """
    keys = list(by)
    named = [f"__by{i}" for i in range(len(keys))]
    kind = left.select(left_time).schema[0].dataType
    own = lambda t: [F.col(k).alias(n) for k, n in zip(keys, named)] + [F.col(t).cast(kind).alias("__time")]
    tied = F.struct(*tie, *(c for c in right.columns if c not in tie)) if right.columns else F.struct()
    usable = F.col(right_time).isNotNull()
    for k in keys:
        usable &= F.col(k).isNotNull()
    r = right.where(usable).select(*own(right_time), F.lit(0).alias("__side"), tied.alias("__right"))
    x = left.select(*own(left_time), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__left"))
    rows = ranged(r.unionByName(x, allowMissingColumns=True), [*named, "__time", "__side"], ranges)

    latest = F.max(F.when(F.col("__side") == 0, F.struct("__time", "__right"))).alias("__last")
    headers = rows.groupBy(RANGE, *named).agg(latest)
    before = Window.partitionBy(*named).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    headers = headers.select(RANGE, *named, F.max("__last").over(before).alias("__met"))

    seen = (Window.partitionBy(RANGE, *named).orderBy(HEAD, "__time", "__side")
            .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    both = _under_headers(rows.withColumn("__met", F.when(F.col("__side") == 0, F.struct("__time", "__right"))), headers)
    met = F.max("__met").over(seen)
    out = both.withColumn("__met", met).where((F.col(HEAD) == 1) & (F.col("__side") == 1))
    fits = F.col("__met").isNotNull() & F.col("__time").isNotNull()
    for n in named:
        fits &= F.col(n).isNotNull()
    if tolerance is not None:
        fits &= F.col("__met.__time") >= F.col("__time") - tolerance
    return out.select(*(F.col("__left")[c].alias(c) for c in left.columns),
                      *(F.when(fits, F.col("__met.__right")[c]).alias(prefix + c) for c in right.columns))
