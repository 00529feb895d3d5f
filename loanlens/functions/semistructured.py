"""Semi-structured text as typed paths: JSON text becomes a VARIANT, paths of it typed columns.

A table stored with ``store`` keeps the paths that its rows share as columns of their
own in the Parquet files, so a query that asks for a path reads that column, not the
text. Malformed text, a missing path and a value of another type give NULL.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHREDDED = {"spark.sql.variant.writeShredding.enabled": "true", "spark.sql.variant.inferShreddingSchema": "true"}


def parsed(df: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """``df`` with the JSON text of ``column`` as a VARIANT; NULL where it is malformed."""
    return df.withColumn(name or column, F.try_parse_json(column))


def path(column: str, where: str, kind: str) -> Column:
    """The value at a path (``$.a.b[0]``) as ``kind``; NULL where it is missing or of another type."""
    return F.try_variant_get(column, where, kind)


def typed(df: DataFrame, column: str, paths: Mapping[str, tuple[str, str]]) -> DataFrame:
    """``df`` with a column for each name: (path, type)."""
    return df.withColumns({n: path(column, where, kind) for n, (where, kind) in paths.items()})


def store(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written as Parquet with its variants' common paths as columns of their own, and read again."""
    spark = df.sparkSession
    before = {k: spark.conf.get(k, None) for k in SHREDDED}
    try:
        for k, v in SHREDDED.items():
            spark.conf.set(k, v)
        df.write.parquet(folder)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.parquet(folder)
