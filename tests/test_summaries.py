"""Percentiles, cubes, largest rows, sketches, snapshots and typed paths against plain computations."""
import math
import random
from collections import Counter
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from loanlens.functions.semistructured import parsed, path, store, typed
from loanlens.operators import snapshots
from loanlens.operators.summaries import cube, estimates, exact_percentiles, largest, merged, sketches

PS = {"low": "0", "p10": "0.1", "median": "0.5", "p99": "0.99", "high": "1"}


def smallest_rank(values, p):
    values = sorted(v for v in values if v is not None)
    return values[max(math.ceil(Decimal(p) * len(values)), 1) - 1] if values else None


@pytest.mark.parametrize("values", [
    [0], [5, 5, 5, 5], list(range(-50, 200)), [-2 ** 61, 2 ** 61, 0, 1, 2], [random.Random(1).randrange(-2 ** 40, 2 ** 40) for _ in range(500)]],
    ids=["one", "equal", "small", "wide", "many"])
def test_percentiles_of_whole_numbers(spark, values):
    """From one 16-bit count to four."""
    rows = [("a", v) for v in values] + [(None, v) for v in values[::2]] + [("nulls", None), ("a", None)]
    out = {r.k: r for r in exact_percentiles(spark.createDataFrame(rows, "k string, v long").repartition(3), ["k"], "v", PS).collect()}
    for k in ("a", None, "nulls"):
        assert {n: out[k][n] for n in PS} == {n: smallest_rank([v for g, v in rows if g == k], p) for n, p in PS.items()}


def test_percentiles_of_other_types_without_keys_and_rows(spark):
    df = spark.sql("SELECT CAST(id AS DECIMAL(12,2)) / 8 AS m, date_add(DATE '2001-01-01', CAST(id * 37 % 101 AS INT)) AS d, timestamp_micros(id * 999983) AS t "
                   "FROM range(1000)").withColumn("m", F.col("m").cast("decimal(12,3)"))
    for c in df.columns:
        values = [r[0] for r in df.select(c).collect()]
        r = exact_percentiles(df, [], c, PS).first()
        assert tuple(r) == tuple(smallest_rank(values, p) for p in PS.values())
    assert exact_percentiles(df.limit(0), ["d"], "m", PS).count() == 0
    with pytest.raises(TypeError):
        exact_percentiles(df.withColumn("m", F.col("m").cast("double")), [], "m", PS)
    with pytest.raises(ValueError):
        exact_percentiles(df, [], "m", {"x": "1.1"})


def test_a_hot_value_is_counted_before_the_shuffle(spark):
    df = spark.range(20_000).selectExpr("IF(id % 3 = 0, id, 7) AS v", "'g' AS k")
    assert exact_percentiles(df, ["k"], "v", {"median": "0.5"}).first().median == 7


def test_cube_equals_sql_and_shuffles_rows_once(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, None]), rng.choice([None, *range(9)])) for _ in range(200)]
    df = spark.createDataFrame(rows, "x string, y int, v long")
    out = cube(df, ["x", "y"], {"s": F.col("v")}, {"lo": F.col("v")}, {"hi": F.col("v")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    con = duckdb.connect()
    con.execute("CREATE TABLE t (x VARCHAR, y INTEGER, v BIGINT)")
    con.executemany("INSERT INTO t VALUES (?, ?, ?)", rows)
    want = con.execute("SELECT x, y, grouping_id(x, y), count(*), CAST(sum(v) AS BIGINT), min(v), max(v) FROM t GROUP BY CUBE (x, y)").fetchall()
    assert Counter(map(tuple, out.collect())) == Counter(want)
    assert plan.count("Expand") == 1 and plan.index("Expand") < plan.rindex("HashAggregate")       # above the aggregate of the rows
    assert cube(df.limit(0), ["x", "y"], {}).count() == 0


def test_largest_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id", "IF(id % 3 = 0, 'hot', string(id % 7)) AS k", "id * 37 % 11 AS v")
    out = largest(df, ["k"], [F.desc("v"), F.asc("id")], 3)
    got = {(r.k, r["rank"], r.id) for r in out.collect()}
    rows = [(r.k, r.v, r.id) for r in df.collect()]
    want = {(k, i + 1, x[2]) for k in {r[0] for r in rows} for i, x in enumerate(sorted((r for r in rows if r[0] == k), key=lambda r: (-r[1], r[2]))[:3])}
    assert got == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_merged_sketches_equal_sketches_of_the_whole_within_their_error(spark, tmp_path):
    df = spark.range(60_000).selectExpr("id % 4 AS segment", "id % 12 AS month", "string(id * 31 % 20011) AS who", "id * 7919 % 100003 AS v")
    sketches(df, ["segment", "month"], {"people": "who"}, {"v": F.col("v")}).write.parquet(str(tmp_path / "s"))
    coarse = merged(spark.read.parquet(str(tmp_path / "s")), ["segment"], ["people"], ["v"])
    for r in estimates(coarse, ["segment"], ["people"], {"v": [0.1, 0.5, 0.99]}).collect():
        own = df.where(F.col("segment") == r.segment)
        people, values = own.select("who").distinct().count(), sorted(x.v for x in own.collect())
        assert r.n == len(values) and abs(r.people - people) <= 0.03 * people
        for p in (0.1, 0.5, 0.99):
            rank = sum(v <= r[f"v_p{round(p * 100)}"] for v in values) / len(values)
            assert abs(rank - p) < 0.02
    # one level more, from merged ones
    total = estimates(merged(coarse.withColumn("all", F.lit(1)), ["all"], ["people"], ["v"]), ["all"], ["people"], {"v": [0.5]}).first()
    assert total.n == 60_000 and abs(total.people - 20_011) <= 0.03 * 20_011


@pytest.fixture()
def two_snapshots(spark, tmp_path):
    old = [(i, f"v{i}", None if i % 7 else 1) for i in range(400)] + [(None, "x", 1), (3, "v3", None), (3, "v3", None)]
    new = [r for r in old if r[0] not in (5, 6)] + [(900, "new", None), (900, "new", None), (3, "v3", None)]
    new = [(i, "changed", n) if i == 17 else (i, v, n) for i, v, n in new]
    for name, rows in (("old", old), ("new", new), ("same", old[::-1])):
        snapshots.store(spark.createDataFrame(rows, "id long, v string, n int").repartition(3), str(tmp_path / name), ["id"], buckets=32)
    return old, new, tmp_path


def test_difference_equals_except_all(spark, two_snapshots):
    old, new, folder = two_snapshots
    rows = snapshots.difference(spark, f"{folder}/old", f"{folder}/new", ["id"]).collect()
    left, right = Counter(old), Counter(new)
    keys_old, keys_new = {r[0] for r in old}, {r[0] for r in new}
    want = {(*r, "changed from" if r[0] in keys_new else "removed", n) for r, n in (left - right).items()} | {
        (*r, "changed to" if r[0] in keys_old else "added", n) for r, n in (right - left).items()}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)


def test_only_changed_buckets_are_read(spark, two_snapshots):
    _, _, folder = two_snapshots
    changed = snapshots.changed_buckets(spark, f"{folder}/old", f"{folder}/new")
    assert 0 < len(changed) <= 5
    out = snapshots.difference(spark, f"{folder}/old", f"{folder}/new", ["id"])
    assert "PartitionFilters: [isnotnull" in out._jdf.queryExecution().executedPlan().toString() or "IN (" in out._jdf.queryExecution().executedPlan().toString()
    assert snapshots.changed_buckets(spark, f"{folder}/old", f"{folder}/same") == []
    assert snapshots.difference(spark, f"{folder}/old", f"{folder}/same", ["id"]).count() == 0


def test_the_root_tells_equal_snapshots_apart(spark, two_snapshots):
    _, _, folder = two_snapshots
    roots = {}
    for name in ("old", "new", "same"):
        levels = snapshots.tree(spark.read.parquet(f"{folder}/{name}/digests")).collect()
        roots[name] = [tuple(r) for r in levels if r.level == max(x.level for x in levels)]
        assert len(roots[name]) == 1
    assert roots["old"] == roots["same"] != roots["new"]


def test_typed_paths(spark, tmp_path):
    texts = ['{"a": {"b": [1, "x"]}, "k": 7}', '{"k": "seven"}', '{"k": 7.5}', '{"k": null}', "{broken", "", None, "[1, 2]", '"text"', '{"k": 3000000000}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, props string")
    table = store(parsed(df, "props"), str(tmp_path / "t"))
    rows = typed(table, "props", {"k": ("$.k", "int"), "b": ("$.a.b[1]", "string"), "second": ("$[1]", "int")}).orderBy("id").collect()
    assert [r.k for r in rows if r.id != 2] == [7] + [None] * 8 and rows[2].k in (7, 8)      # Spark's cast decides on 7.5
    assert [r.b for r in rows] == ["x"] + [None] * 9 and [r.second for r in rows][7] == 2
    assert table.where(F.col("props").isNull()).count() == 3
    # the scan reads the path, not the whole text
    plan = table.select(path("props", "$.k", "int").alias("k"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<props:struct<0:int" in plan
