"""Text comparison under a database collation, chosen by parameter.

The reference compares text as its host does by default: without regard to case
and to blanks at the end, so ``'completed '`` and ``'Completed'`` are one status in
every ``=``, ``IN``, ``LIKE`` and ``GROUP BY``. Here text compares byte by byte
unless a collation is asked for: ``collated`` gives the text columns a Spark
collation, and all analyses then follow it, as their predicates and keys take the
collation of the column.

Which spelling stands for a group is not defined by SQL (any of them may). Here it
is the smallest one in byte order (``grouped``), so results do not depend on the
order of rows.

Cost: Spark groups collated keys by sorting. It still combines before the shuffle,
so a hot status costs one row for each task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Case and trailing blanks do not count.
CASE_AND_BLANKS = "UTF8_LCASE_RTRIM"
BINARY = "UTF8_BINARY"


def is_collated(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType) and getattr(kind, "collation", BINARY) != BINARY


def collated(df: DataFrame, collation: str | None = CASE_AND_BLANKS, columns: Sequence[str] | None = None) -> DataFrame:
    """``df`` with its text columns (or ``columns``) under ``collation``; None leaves it as it is."""
    if collation is None:
        return df
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)] if columns is None else columns
    return df.withColumns({n: F.collate(F.col(n), collation) for n in names})


def plain(df: DataFrame) -> DataFrame:
    """``df`` with plain text columns, for a result that other tools read."""
    return df.withColumns({f.name: F.collate(F.col(f.name), BINARY) for f in df.schema.fields if is_collated(f.dataType)})


class Grouped:
    """Groups whose collated keys come out in their smallest spelling, as plain text."""

    def __init__(self, df: DataFrame, keys: Sequence):
        self.df, self.keys = df, [F.col(k) if isinstance(k, str) else k for k in keys]
        self.fields = df.select(*self.keys).schema.fields if keys else []

    def agg(self, *measures: Column) -> DataFrame:
        spelled = [(f"__key{i}", f.name, k) for i, (f, k) in enumerate(zip(self.fields, self.keys)) if is_collated(f.dataType)]
        if not spelled:
            return self.df.groupBy(*self.keys).agg(*measures)
        inner = {name: inside for inside, name, _ in spelled}
        keys = [k.alias(inner.get(f.name, f.name)) for f, k in zip(self.fields, self.keys)]
        out = self.df.groupBy(*keys).agg(*(F.min(F.collate(k, BINARY)).alias(name) for _, name, k in spelled), *measures)
        first = [f.name for f in self.fields]
        return out.select(*first, *(c for c in out.columns if c not in first and c not in inner.values()))


def grouped(df: DataFrame, *keys) -> Grouped:
    """``df.groupBy(*keys)`` that spells collated keys the same way in every run."""
    return Grouped(df, keys)
