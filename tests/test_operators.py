"""The reusable operators on small inline frames."""
from decimal import Decimal

from pyspark.sql import functions as F

from loanlens.functions.buckets import Ladder
from loanlens.functions.canon import n_rows
from loanlens.operators.output import sorted_result
from loanlens.operators.profile import profile_with_total, segment_profile, share_of_groups
from loanlens.operators.ranking import concentration_curve, multi_rank
from loanlens.operators.rollup import entity_rollup, windowed_baseline
from loanlens.operators.scoring import additive_score, rule_label, scenario_grid


def test_profile_with_total_equals_group_plus_scalar_total(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("b", 2), (None, 3), ("b", None)], "k string, v int")
    g = profile_with_total(df, ["k"], keep=F.col("v").isNotNull(), measures={"s": F.sum("v")},
                           totals={"all_rows": "n"})
    got = {r["k"]: (r["n"], r["s"], r["all_rows"]) for r in g.collect()}
    # groups over the kept rows only; total over all five rows (NULL keys included)
    assert got == {"a": (1, 1, 5), "b": (1, 2, 5), None: (1, 3, 5)}


def test_segment_profile_min_count_and_share(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 1 + [("c",)] * 4, "k string")
    g = segment_profile(df, ["k"], {}, min_count=2)
    g = share_of_groups(g, "n", "share")
    got = {r["k"]: r["share"] for r in g.collect()}
    assert got == {"a": Decimal("42.86"), "c": Decimal("57.14")}     # share of surviving groups


def test_entity_rollup_two_levels_with_having(spark):
    df = spark.createDataFrame([("m1",), ("m1",), ("m2",), ("m3",), ("m3",), ("m3",)], "m string")
    out = entity_rollup(df, "m", {"loans": n_rows()}, ["loans"], {"members": n_rows()},
                        having=F.col("loans") <= 2)
    assert {(r["loans"], r["members"]) for r in out.collect()} == {(1, 1), (2, 1)}


def test_concentration_curve_breaks_ties_and_runs_total(spark):
    df = spark.createDataFrame([("x", 5, Decimal("25.00")), ("y", 5, Decimal("25.00")),
                                ("z", 10, Decimal("50.00"))],
                               "k string, n int, share decimal(5,2)")
    out = concentration_curve(df, "rank", [F.desc("n"), F.asc("k")], "share", "cum",
                              "tier", Ladder((("<=", 1, "top"),), "rest"))
    rows = sorted_result(out, "rank").collect()
    assert [(r["k"], r["rank"], r["cum"], r["tier"]) for r in rows] == [
        ("z", 1, Decimal("50.00"), "top"), ("x", 2, Decimal("75.00"), "rest"),
        ("y", 3, Decimal("100.00"), "rest")]


def test_multi_rank_ties_share_a_rank(spark):
    df = spark.createDataFrame([("a", 3.0, 1), ("b", 3.0, 2), ("c", 1.0, 3)], "k string, x double, y int")
    out = {r["k"]: (r["rx"], r["ry"]) for r in
           multi_rank(df, {"rx": [F.desc("x")], "ry": [F.desc("y")]}).collect()}
    assert out == {"a": (1, 3), "b": (1, 2), "c": (3, 1)}


def test_scenario_grid_is_one_row_per_scenario(spark):
    one = spark.createDataFrame([(Decimal("100.00"),)], "loss decimal(15,2)")
    g = scenario_grid(one, [("base", None), ("up", "1.50")])
    rows = {r["scenario"]: r["multiplier"] for r in g.collect()}
    assert rows == {"base": None, "up": Decimal("1.50")}
    assert g.count() == 2


def test_additive_score_and_rule_label(spark):
    df = spark.createDataFrame([(1, "x"), (5, None)], "a int, b string")
    out = additive_score(df, {"pa": ("a", Ladder((("<", 3, 0),), 2)),
                              "pb": ("b", Ladder((("=", "x", 0),), 1))}, "score")
    out = out.withColumn("label", rule_label([(F.col("score") >= 3, "high"),
                                              (F.col("score") >= 1, "mid")], "low"))
    assert [(r["score"], r["label"]) for r in sorted_result(out, "a").collect()] == [(0, "low"), (3, "high")]


def test_windowed_baseline_truncates(spark):
    df = spark.createDataFrame([(2000, 1), (2000, 2), (2001, 5)], "y int, n int")
    out = {(r["y"], r["n"]): r["base"] for r in windowed_baseline(df, "y", "n", "base").collect()}
    assert out == {(2000, 1): 1, (2000, 2): 1, (2001, 5): 5}


def test_scale_conf_sizes_partitions():
    from loanlens.session import scale_conf
    c = scale_conf(100 * 1024 ** 4)
    assert c["spark.sql.shuffle.partitions"] == "409600"
    assert scale_conf(1)["spark.sql.shuffle.partitions"] == "8"
