"""Differences of two stored snapshots of a table, by comparing digests before rows.

A snapshot is stored in buckets of its key's hash, with a digest of every bucket: row
count and two sums of row hashes, which do not depend on the order of rows and count
repeated rows. A difference compares the digests, and reads only buckets that differ
(partition pruning); for a table of which a thousandth changes in few buckets that is a
small part of its bytes. Rows of these buckets are compared as a multiset.

The digests form a tree: ``tree`` sums buckets up to a root, so equal snapshots are told
apart from different ones by one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "__bucket"
FAN = 16


def _row_hash(columns: Sequence[str], seed: int) -> Column:
    # nulls are skipped by the hash, so their places are hashed with the values
    return F.xxhash64(F.lit(seed), *columns, *(F.col(c).isNull() for c in columns))


def _digest(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    wide = lambda seed: F.sum(_row_hash(columns, seed).cast("decimal(20,0)")).alias(f"sum_{seed}")
    return rows.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("n"), wide(1), wide(2))


def store(df: DataFrame, folder: str, keys: Sequence[str], buckets: int = 64) -> None:
    """Writes ``df`` and its digests to ``folder`` (shared). Snapshots are comparable if keys and ``buckets`` are the same."""
    rows = df.withColumn(BUCKET, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    # a file for each bucket and task: no shuffle, so no bucket is one task's
    rows.write.partitionBy(BUCKET).parquet(f"{folder}/rows")
    stored = df.sparkSession.read.parquet(f"{folder}/rows") if df.columns else rows
    _digest(stored, df.columns).write.parquet(f"{folder}/digests")


def _read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/rows"), spark.read.parquet(f"{folder}/digests")


def tree(digests: DataFrame) -> DataFrame:
    """The digests of all levels: level 0 the buckets, each level above sums ``FAN`` nodes; the last has one."""
    last = digests.agg(F.max(BUCKET)).first()[0] or 0
    level, out = 0, digests.select(F.lit(0).alias("level"), F.col(BUCKET).alias("node"), "n", "sum_1", "sum_2")
    now = out
    while last:
        level, last = level + 1, last // FAN
        now = now.groupBy(F.floor(F.col("node") / FAN).cast("int").alias("node")).agg(
            *(F.sum(c).cast("long" if c == "n" else "decimal(38,0)").alias(c) for c in ("n", "sum_1", "sum_2")))
        out = out.unionByName(now.select(F.lit(level).alias("level"), "node", "n", "sum_1", "sum_2"))
    return out


def changed_buckets(spark: SparkSession, old: str, new: str) -> list[int]:
    """Buckets that are not equal; at most as many as there are buckets."""
    a, b = (_read(spark, f)[1] for f in (old, new))
    same = a.select(BUCKET, "n", "sum_1", "sum_2").intersect(b.select(BUCKET, "n", "sum_1", "sum_2")).select(BUCKET)
    return sorted(r[0] for r in a.select(BUCKET).union(b.select(BUCKET)).distinct().join(same, BUCKET, "left_anti").collect())


def difference(spark: SparkSession, old: str, new: str, keys: Sequence[str]) -> DataFrame:
    """The columns, ``change`` and ``copies``: rows that only one snapshot has, or has more often.

    ``change``: "added" and "removed" where the key is in one of them only, "changed from" and "changed to" where it is in both.
    ``copies``: how many more there are.
    """
    buckets = changed_buckets(spark, old, new)
    a, b = (_read(spark, f)[0].where(F.col(BUCKET).isin(buckets)) for f in (old, new))
    columns = [c for c in a.columns if c != BUCKET]
    both = a.select(*columns, F.lit(-1).alias("__side")).unionByName(b.select(*columns, F.lit(1).alias("__side")))
    rows = both.groupBy(*columns).agg(F.sum("__side").cast("long").alias("__more")).where("__more <> 0")
    held = both.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.bool_or(F.col("__side") < 0).alias("__old"), F.bool_or(F.col("__side") > 0).alias("__new"))
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = same if on is None else on & same
    known = F.col("__old") & F.col("__new")
    change = (F.when(known & (F.col("__more") < 0), "changed from").when(known, "changed to")
              .when(F.col("__more") < 0, "removed").otherwise("added"))
    return rows.join(held, on).select(*columns, change.alias("change"), F.abs("__more").alias("copies"))
