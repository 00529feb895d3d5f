"""Interval joins against DuckDB: intervals of very different lengths, edges, nulls, hot keys."""
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loanlens.operators.joins import interval_join


def data(spark, seed=3, n=300):
    rng = random.Random(seed)
    points = [(i, rng.choice(["hot"] * 9 + ["a", None]), rng.choice([None, *range(-200, 1000)])) for i in range(n)]
    spans = []
    for i in range(n // 2):
        s = rng.choice([None, *range(-300, 900)])
        e = rng.choice([None, s, None if s is None else s + rng.choice([1, 2, 3, 17, 64, 400, 5000]), 0])
        spans.append((i, rng.choice(["hot"] * 9 + ["b", "a", None]), s, e))
    return (points, spans, spark.createDataFrame(points, "p long, k string, at long"), spark.createDataFrame(spans, "q long, k string, s long, e long"))


def duck(points, spans, sql):
    con = duckdb.connect()
    con.execute('CREATE TABLE points (p BIGINT, k VARCHAR, "at" BIGINT); CREATE TABLE spans (q BIGINT, k VARCHAR, s BIGINT, e BIGINT)')
    con.executemany("INSERT INTO points VALUES (?, ?, ?)", points)
    con.executemany("INSERT INTO spans VALUES (?, ?, ?, ?)", spans)
    return sorted(con.execute(sql).fetchall(), key=str)


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("closed", [False, True])
def test_equals_sql(spark, by, how, closed):
    points, spans, left, right = data(spark)
    got = interval_join(left, right, at="at", start="s", end="e", by=by, how=how, closed=closed)
    same_key = "points.k = spans.k AND " if by else ""
    want = duck(points, spans, f'SELECT p, q FROM points {how} JOIN spans ON {same_key} s <= "at" AND "at" {"<=" if closed else "<"} e')
    assert sorted(((r.p, r.right_q) for r in got.collect()), key=str) == want


def test_rows_grow_with_the_pairs_not_with_the_length(spark):
    """An interval over all points is two rows, not one for each bucket of some fixed width."""
    left = spark.range(1000).select(F.col("id").alias("at"))
    right = spark.createDataFrame([(0, 10 ** 15), (500, 501)], "s long, e long")
    got = interval_join(left, right, at="at", start="s", end="e")
    assert got.count() == 1001
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date"])
def test_times_and_dates(spark, kind):
    left = spark.sql(f"SELECT CAST(x AS {kind}) AS at FROM VALUES ('1969-12-30'), ('2024-01-01'), ('2024-02-01') AS t(x)")
    right = spark.sql(f"SELECT CAST(a AS {kind}) AS s, CAST(b AS {kind}) AS e FROM VALUES ('1969-01-01', '2024-02-01') AS t(a, b)")
    assert interval_join(left, right, at="at", start="s", end="e").count() == 2


def test_empty_sides_and_types(spark):
    _, _, left, right = data(spark)
    assert interval_join(left, right.limit(0), at="at", start="s", end="e").count() == 0
    assert interval_join(left, right.limit(0), at="at", start="s", end="e", how="left").count() == left.count()
    assert interval_join(left.limit(0), right, at="at", start="s", end="e").count() == 0
    with pytest.raises(TypeError):
        interval_join(left.withColumn("at", F.col("at").cast("double")), right, at="at", start="s", end="e")
