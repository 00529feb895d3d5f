"""Windows and as-of joins over raw rows against DuckDB: hot keys, keys that go on over many ranges, nulls, ties, empty input."""
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loanlens.operators.ranges import RANGE, asof_join, ranged, windows


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def table(spark, n=400, keys=("hot",) * 30 + ("a", "b", None, "c"), seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.choice(keys), rng.choice([None, *range(12)]), rng.choice([None, *range(-50, 50)])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, k string, t int, v long").repartition(3)


def duck(rows, sql, columns="id BIGINT, k VARCHAR, t INTEGER, v BIGINT"):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE x ({columns})")
    if rows:
        con.executemany(f"INSERT INTO x VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return sorted(con.execute(sql).fetchall(), key=str)


ALL = dict(row_number="rn", dense_rank="dr", ntile={"n7": 7, "n500": 500}, running_sum={"run": "v"}, moving_sum={"m3": ("v", 3), "m40": ("v", 40)},
           lag={"l1": ("v", 1), "l25": ("id", 25)}, lead={"d2": ("v", 2), "d30": ("id", 30)}, first_value={"f": "v"}, last_value={"z": "id"})


def window_sql(partition):
    over = f"({f'PARTITION BY {partition} ' if partition else ''}ORDER BY t NULLS FIRST, id"
    whole = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
    return f"""SELECT id, k, t, v, row_number() OVER {over}), dense_rank() OVER {over.replace(', id', '')}), ntile(7) OVER {over}), ntile(500) OVER {over}),
      CAST(sum(v) OVER {over} ROWS UNBOUNDED PRECEDING) AS BIGINT), CAST(sum(v) OVER {over} ROWS 3 PRECEDING) AS BIGINT),
      CAST(sum(v) OVER {over} ROWS 40 PRECEDING) AS BIGINT), lag(v) OVER {over}), lag(id, 25) OVER {over}), lead(v, 2) OVER {over}),
      lead(id, 30) OVER {over}), first_value(v) OVER {over} {whole}), last_value(id) OVER {over} {whole}) FROM x"""


@pytest.mark.parametrize("ranges", [1, 7, 60])
@pytest.mark.parametrize("partition", ["", "k"])
def test_windows_equal_sql(spark, ranges, partition):
    """60 ranges of 400 rows hold fewer rows than the frames, so results come from many ranges back."""
    rows, df = table(spark)
    got = windows(df, ["t", "id"], [partition] if partition else [], ranges=ranges, **ALL)
    assert rows_of(got) == duck(rows, window_sql(partition))


def test_windows_of_nothing_and_of_one_row(spark):
    _, df = table(spark)
    assert windows(df.limit(0), ["t", "id"], ["k"], **ALL).count() == 0
    r = windows(df.where("id = 5"), ["t", "id"], **ALL).first()
    assert (r.rn, r.dr, r.n7, r.n500, r.l1, r.d2, r.z) == (1, 1, 1, 1, None, None, 5) and r.run == r.v == r.m3


def test_a_hot_key_is_spread_over_ranges(spark):
    df = spark.range(40_000).selectExpr("id", "IF(id % 3 = 0, id, -1) AS k", "id % 1000 AS t")
    sizes = [r["count"] for r in ranged(df, ["k", "t", "id"], 16).groupBy(RANGE).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 40_000 / 16        # two thirds of the rows have one key
    plan = windows(df, ["t", "id"], ["k"], row_number="rn", ranges=16)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Join" not in plan
    # without a key, only one row for each range goes to one task
    found = windows(df, ["t", "id"], row_number="rn", running_sum={"s": "id"}, ranges=16)
    assert tuple(found.agg(F.count_distinct("rn"), F.max("rn"), F.max("s")).first()) == (40_000, 40_000, sum(range(40_000)))


def asof_sql(tolerance=""):
    return f"""SELECT l.id, l.k, l.t, r.id, r.t, r.v FROM (SELECT * FROM x WHERE side = 'l') l ASOF LEFT JOIN
      (SELECT k, t, max(id) AS id, arg_max_null(v, id) AS v FROM x WHERE side = 'r' AND t IS NOT NULL AND k IS NOT NULL GROUP BY k, t) r
      ON l.k = r.k AND l.t >= r.t"""


@pytest.mark.parametrize("ranges", [1, 9, 50])
def test_asof_join_equals_duckdb(spark, ranges):
    rng = random.Random(ranges)
    rows = [(i, rng.choice(["hot"] * 20 + ["a", None]), rng.choice([None, *range(300)]), rng.choice([None, 1, 2]), "lr"[rng.random() < 0.3]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, k string, t int, v long, side string").repartition(4)
    left, right = df.where("side = 'l'").select("id", "k", "t"), df.where("side = 'r'").select("k", "id", "t", "v")
    got = asof_join(left, right, left_time="t", right_time="t", by=["k"], tie=["id"], ranges=ranges)
    assert rows_of(got.select("id", "k", "t", "right_id", "right_t", "right_v")) == duck(
        rows, asof_sql(), "id BIGINT, k VARCHAR, t INTEGER, v BIGINT, side VARCHAR")
    near = asof_join(left, right, left_time="t", right_time="t", by=["k"], tie=["id"], tolerance=F.lit(2), ranges=ranges).collect()
    want = {r.id: r for r in got.collect()}
    assert all((r.right_t if w.right_t is not None and w.t - w.right_t <= 2 else None) == r.right_t and (r.right_t is not None) == (
        w.right_t is not None and w.t - w.right_t <= 2) for r in near for w in [want[r.id]])


def test_asof_join_without_keys_and_without_rows(spark):
    left = spark.createDataFrame([(1, 5), (2, 9), (3, None)], "a int, t int")
    right = spark.createDataFrame([(4, "x"), (9, "y"), (None, "z")], "t int, name string")
    got = asof_join(left, right, left_time="t", right_time="t")
    assert {r.a: r.right_name for r in got.collect()} == {1: "x", 2: "y", 3: None}
    assert {r.right_name for r in asof_join(left, right.limit(0), left_time="t", right_time="t").collect()} == {None}
    assert asof_join(left.limit(0), right, left_time="t", right_time="t").count() == 0


def test_no_cross_join_in_the_plan(spark):
    _, df = table(spark)
    plan = asof_join(df, df, left_time="t", right_time="t", by=["k"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan
