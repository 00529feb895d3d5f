"""Exact percentiles, cubes, largest rows and mergeable sketches of groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loanlens.session import checkpoint_dir

DIGIT_BITS = 16


def _units(column: Column, kind: T.DataType) -> tuple[Column, Callable[[Column], Column]]:
    """(the value as a whole number, how to get the value back)."""
    if isinstance(kind, T.IntegralType):
        return column.cast("long"), lambda x: x.cast(kind)
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        unit = Decimal(1).scaleb(-kind.scale)
        wide = T.DecimalType(38, 0)
        return (column.cast(T.DecimalType(38, kind.scale)) / F.lit(unit)).cast("long"), lambda x: (x.cast(wide) * F.lit(unit)).cast(kind)
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long"), lambda x: F.date_from_unix_date(x.cast("int"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column), F.timestamp_micros
    raise TypeError(f"percentiles need whole numbers, decimals of 18 digits, dates or times, not {kind.simpleString()}")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, percentiles: Mapping[str, Decimal | str]) -> DataFrame:
    """Discrete percentiles of ``value`` by group: the smallest value that at least the share p of the group's values does not exceed.

    Selection by refined histograms: values are whole numbers, whose leading 16 bits are counted by group; the cell that holds the wanted
    rank is counted by its next 16 bits, and so on: four counts at most for 64 bits, fewer for a narrower range. Only counts are
    shuffled, combined before, so neither a hot group nor a hot value is in one task; a group's histogram has 65,536 cells at most.
    Between the counts the wanted cells (a row for each group and percentile) are stored.

    Null values do not count; a group without values has nulls; null keys are a group.
    """
    checkpoint_dir(df.sparkSession)
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("all"))
    number, back = _units(F.col(value), df.schema[value].dataType)
    rows = df.select(group.alias("__g"), number.alias("__v"))
    least, most = rows.agg(F.min("__v"), F.max("__v")).first()
    groups = rows.groupBy("__g").agg(F.count("__v").alias("__n"))
    if least is None:
        least = most = 0
    if most - least >= 2 ** 63:
        raise ValueError("the values span more than 63 bits")
    rows = rows.where(F.col("__v").isNotNull()).select("__g", (F.col("__v") - F.lit(least)).alias("__u"))

    names = {n: Decimal(str(p)) for n, p in percentiles.items()}
    for p in names.values():
        if not 0 <= p <= 1:
            raise ValueError(f"{p} is no share")
    ranks = [F.struct(F.lit(n).alias("name"), F.greatest(F.ceil(F.col("__n") * F.lit(p)), F.lit(1)).cast("long").alias("rank")) for n, p in names.items()]
    live = groups.where("__n > 0").select("__g", F.lit(0).cast("long").alias("__prefix"), F.inline(F.array(*ranks)))
    width = (most - least).bit_length()
    shifts = list(range(max(width - DIGIT_BITS, 0), 0, -DIGIT_BITS)) + [0]
    above = None
    for shift in shifts:
        live = live.checkpoint(eager=True)
        taken = min(DIGIT_BITS, (width if above is None else above) - shift) or 1
        cell = F.shiftright("__u", shift)
        counted = rows.select("__g", F.shiftright(cell, taken).alias("__prefix"), cell.bitwiseAND(F.lit((1 << taken) - 1)).alias("__digit"))
        if above is not None:
            counted = counted.join(live.select("__g", "__prefix").distinct(), ["__g", "__prefix"])
        cells = counted.groupBy("__g", "__prefix", "__digit").agg(F.count(F.lit(1)).alias("__c"))
        upto = F.sum("__c").over(Window.partitionBy("__g", "__prefix").orderBy("__digit"))
        cells = cells.withColumn("__upto", upto)
        live = (cells.join(live, ["__g", "__prefix"]).where((F.col("rank") <= F.col("__upto")) & (F.col("rank") > F.col("__upto") - F.col("__c")))
                .select("__g", F.shiftleft("__prefix", taken).bitwiseOR(F.col("__digit")).alias("__prefix"), "name",
                        (F.col("rank") - F.col("__upto") + F.col("__c")).alias("rank")))
        above = shift
    found = live.groupBy("__g").agg(*(F.max(F.when(F.col("name") == n, F.col("__prefix"))).alias(n) for n in names))
    out = groups.join(found, "__g", "left")
    return out.select(*(F.col("__g")[k].alias(k) for k in keys), *(back(F.col(n) + F.lit(least)).alias(n) for n in names))


def cube(df: DataFrame, keys: Sequence[str], sums: Mapping[str, Column], least: Mapping[str, Column] | None = None,
         most: Mapping[str, Column] | None = None, count: str = "n") -> DataFrame:
    """``GROUP BY CUBE``: counts, sums, minima and maxima of every subset of ``keys``, with ``grouping_id``.

    Rows are aggregated once, by all keys, and shuffled once, combined before; the coarser sets come from these groups, not from
    the rows, which Spark's own cube would copy 2 ** keys times.
    """
    least, most = least or {}, most or {}
    finest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), *(F.sum(x).alias(n) for n, x in sums.items()),
                                   *(F.min(x).alias(n) for n, x in least.items()), *(F.max(x).alias(n) for n, x in most.items()))
    kinds = {f.name: f.dataType for f in finest.schema.fields}
    out = finest.cube(*keys).agg(F.grouping_id().cast("long").alias("grouping_id"), *(F.sum(n).cast(kinds[n]).alias(n) for n in (count, *sums)),
                                 *(F.min(n).alias(n) for n in least), *(F.max(n).alias(n) for n in most))
    return out.select(*keys, "grouping_id", count, *sums, *least, *most)


def largest(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group in ``order`` (which ends with a unique column), with their rank.

    Spark limits the groups before the shuffle, too: a task sends k rows a group, so a hot group costs k rows a task.
    """
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def sketches(df: DataFrame, keys: Sequence[str], distinct: Mapping[str, str], quantiles: Mapping[str, Column]) -> DataFrame:
    """Sketches by group, to be stored: HyperLogLog of ``distinct`` columns, KLL of whole-number ``quantiles``. A few KB a group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.hll_sketch_agg(c, 14).alias(n) for n, c in distinct.items()),
                                 *(F.kll_sketch_agg_bigint(x.cast("long"), 400).alias(n) for n, x in quantiles.items()))


def merged(stored: DataFrame, keys: Sequence[str], distinct: Sequence[str], quantiles: Sequence[str]) -> DataFrame:
    """Stored sketches for a coarser cut: merged, without a look at the rows."""
    return stored.groupBy(*keys).agg(F.sum("n").alias("n"), *(F.hll_union_agg(c).alias(c) for c in distinct),
                                     *(F.kll_merge_agg_bigint(c).alias(c) for c in quantiles))


def estimates(stored: DataFrame, keys: Sequence[str], distinct: Sequence[str], quantiles: Mapping[str, Sequence[float]]) -> DataFrame:
    """What the sketches say: ``<name>`` distinct values, ``<name>_p<percent>`` quantiles."""
    return stored.select(*keys, "n", *(F.hll_sketch_estimate(c).alias(c) for c in distinct),
                         *(F.kll_sketch_get_quantile_bigint(c, F.lit(p)).alias(f"{c}_p{round(p * 100)}") for c, ps in quantiles.items() for p in ps))
