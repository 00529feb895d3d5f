"""The reusable operators (G1-G15) applied to the driver's native tables.

These show the operators are not tied to the loan table: each instance
reads the TPC-style tables (or the events / documents / labels tables),
uses one operator as its core, and has its own DuckDB oracle. Cut points
and labels here are parameters of the instances, not values of the
reference.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanlens.functions import canon as K
from loanlens.functions.buckets import Ladder, bucketize
from loanlens.functions.canon import D, dec
from loanlens.operators.profile import calibration, segment_profile, share_of_groups
from loanlens.operators.ranking import concentration_curve, multi_rank
from loanlens.operators.rollup import cohort_trend, entity_rollup, windowed_baseline
from loanlens.operators.scoring import additive_score, rule_label, scenario_grid
from loanlens.plans import sqlkit as S
from loanlens.sources.tables import read_table

# instance parameters
DISCOUNT_BANDS = Ladder((("<", Decimal("0.03"), "Low discount"),
                         ("<", Decimal("0.07"), "Mid discount")), "High discount")
BRAND_TIERS = Ladder((("<=", 5, "Top 5 brands"), ("<=", 15, "Top 15 brands")), "Other brands")
BALANCE_POINTS = Ladder((("<", 0, 3), ("<", 3000, 2), ("<", 7000, 1)), 0)
SEGMENT_POINTS = Ladder((("=", "AUTOMOBILE", 2), ("=", "MACHINERY", 1)), 0)
NATION_POINTS = Ladder((("<", 5, 1), ("<", 15, 2)), 3)
CUSTOMER_CATEGORY = Ladder((("<=", 1, "Low"), ("<=", 3, "Medium")), "High")
LENGTH_BANDS = Ladder((("<", 1000, "short"), ("<", 10000, "medium")), "long")
REVENUE_SCENARIOS = (("Baseline", None), ("Discount +10%", "1.10"), ("Discount +50%", "1.50"))
ORDER_MIN_GROUP = 100


def _t(spark, sf_dir, name):
    return read_table(spark, sf_dir, name)


def _ext():
    return F.col("l_extendedprice").cast(D(15, 2))


def g01_bucketize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by discount band: lines and gross revenue."""
    li = _t(spark, sf_dir, "lineitem")
    return segment_profile(
        li.withColumn("discount_band", bucketize(F.col("l_discount").cast(D(10, 4)), DISCOUNT_BANDS)),
        ["discount_band"], {"revenue": F.sum(_ext()).cast(D(38, 2))}, count_name="lines")


def g02_flag_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returned-line rate per ship year (flag average and rounded percentage)."""
    li = _t(spark, sf_dir, "lineitem").withColumn("ship_year", F.year("l_shipdate"))
    r = F.col("l_returnflag") == "R"
    return segment_profile(li, ["ship_year"], {
        "returned_rate": K.flag_rate(r),
        "returned_pct": K.pct(K.count_if(r), K.n_rows()),
    }, count_name="lines")


def g03_segment_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority x market segment, groups with >= 100 orders."""
    o = _t(spark, sf_dir, "orders")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    df = o.join(c, o.o_custkey == c.c_custkey)
    return segment_profile(df, ["o_orderpriority", "c_mktsegment"], {
        "avg_total_price": K.avg_x(F.col("o_totalprice").cast(D(15, 2))),
        "fulfilled_pct": K.pct(K.count_if(F.col("o_orderstatus") == "F"), K.n_rows()),
    }, count_name="orders", min_count=ORDER_MIN_GROUP)


def _orders_by_nation(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    per_cust = o.groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice").cast(D(15, 2))).alias("amt"), K.n_rows().alias("cnt"))
    return (per_cust.join(c, per_cust.o_custkey == c.c_custkey)
            .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy("n_name").agg(F.sum("amt").cast(D(38, 2)).alias("order_value"),
                                   F.sum("cnt").cast("bigint").alias("orders")))


def g04_portfolio_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value and order-count share per nation (share of all groups).

    Orders are pre-aggregated per customer before the customer join, so the
    join moves one row per customer instead of one per order.
    """
    g = _orders_by_nation(spark, sf_dir)
    g = share_of_groups(g, "orders", "orders_share_pct")
    total = F.sum("order_value").over(Window.partitionBy())
    return g.withColumn("value_share_pct", K.pct("order_value", total))


def g05_cohort_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per year x quarter: count, average and total price."""
    price = F.col("o_totalprice").cast(D(15, 2))
    return cohort_trend(_t(spark, sf_dir, "orders"), "o_orderdate", ["year", "quarter"], {
        "orders": K.n_rows(), "avg_price": K.avg_x(price),
        "total_price": F.sum(price).cast(D(38, 2)),
    }, names={"year": "order_year", "quarter": "order_quarter"})


def g06_entity_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users grouped by their event count: users, mean total value per user."""
    ev = _t(spark, sf_dir, "events")
    return entity_rollup(
        ev, "user_id",
        inner={"events": K.n_rows(), "total_value": F.sum(F.col("value").cast(D(18, 4)))},
        outer_keys=["events"],
        outer={"users": K.n_rows(), "avg_total_value": K.avg_x("total_value")},
        where=F.col("user_id").isNotNull())


def g07_concentration_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand revenue: rank, share of all revenue, running share, brand tier."""
    li = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_extendedprice")
    per_part = li.groupBy("l_partkey").agg(F.sum(_ext()).alias("rev"))
    p = _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    g = (per_part.join(p, per_part.l_partkey == p.p_partkey)
         .groupBy("p_brand").agg(F.sum("rev").cast(D(38, 2)).alias("brand_revenue")))
    total = F.sum("brand_revenue").over(Window.partitionBy())
    g = g.withColumn("revenue_share_pct", K.pct("brand_revenue", total))
    return concentration_curve(g, "brand_rank", [F.desc("brand_revenue"), F.asc("p_brand")],
                               "revenue_share_pct", "cumulative_share_pct",
                               "brand_tier", BRAND_TIERS) \
        .withColumn("cumulative_share_pct", F.col("cumulative_share_pct").cast(D(18, 2)))


def g08_multi_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations ranked by order value, order count and average order value."""
    g = _orders_by_nation(spark, sf_dir).withColumn(
        "avg_order_value", K.to_double("order_value") / F.col("orders"))
    return multi_rank(g, {"value_rank": [F.desc("order_value")],
                          "count_rank": [F.desc("orders")],
                          "avg_value_rank": [F.desc("avg_order_value")]})


def g09_scenario_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net revenue if every discount were scaled by a multiplier."""
    li = _t(spark, sf_dir, "lineitem")
    ext = _ext()
    disc_amt = ext * F.col("l_discount").cast(D(10, 4))
    base = li.agg(F.sum(ext).cast(D(38, 2)).alias("gross"),
                  F.sum(disc_amt).cast(D(38, 6)).alias("discounts"))
    g = scenario_grid(base, REVENUE_SCENARIOS)
    m = F.coalesce(F.col("multiplier"), dec("1.00"))
    return g.select("scenario", "gross",
                    F.round(F.col("discounts") * m, 2).cast(D(38, 2)).alias("discounts"),
                    F.round(F.col("gross") - F.col("discounts") * m, 2).cast(D(38, 2))
                    .alias("net_revenue"))


def g10_additive_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers scored from balance, segment and nation points; count per category."""
    c = _t(spark, sf_dir, "customer")
    df = additive_score(c, {"balance_points": ("c_acctbal", BALANCE_POINTS),
                            "segment_points": ("c_mktsegment", SEGMENT_POINTS),
                            "nation_points": ("c_nationkey", NATION_POINTS)}, "score")
    df = df.withColumn("category", bucketize("score", CUSTOMER_CATEGORY))
    return segment_profile(df, ["category"], {"avg_score": K.avg_x("score"),
                                              "min_score": F.min("score"),
                                              "max_score": F.max("score")},
                           count_name="customers")


def g11_rule_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders labelled by a first-match rule list; count and value per label."""
    o = _t(spark, sf_dir, "orders")
    st, pr = F.col("o_orderstatus"), F.col("o_orderpriority")
    label = rule_label([((st == "F") & pr.isin("1-URGENT", "2-HIGH"), "Closed priority"),
                        (st == "F", "Closed"),
                        (st == "O", "Open")], "Partial")
    return segment_profile(o.withColumn("order_class", label), ["order_class"], {
        "total_price": F.sum(F.col("o_totalprice").cast(D(15, 2))).cast(D(38, 2))},
        count_name="orders")


def g12_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order date -> ship date per priority: days (exact mean, max) and month boundaries."""
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_shipdate")
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    df = li.join(o, li.l_orderkey == o.o_orderkey)
    days = K.day_diff(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date"))
    months = K.month_boundaries("o_orderdate", "l_shipdate")
    return segment_profile(df.withColumn("days", days).withColumn("months", months),
                           ["o_orderpriority"], {
                               "avg_days": K.avg_x("days"), "max_days": F.max("days"),
                               "avg_months": K.iavg("months")}, count_name="lines")


def g13_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents per length band: quality and toxicity rates."""
    lab = _t(spark, sf_dir, "labels")
    docs = _t(spark, sf_dir, "documents").select("doc_id", "n_chars")
    df = lab.join(docs, "doc_id").withColumn("length_band", bucketize("n_chars", LENGTH_BANDS))
    return calibration(df, "length_band",
                       {"docs": K.n_rows(), "avg_chars": K.avg_x("n_chars")},
                       {"quality_rate": K.flag_rate(F.col("quality") == 1),
                        "toxic_rate": K.flag_rate(F.col("toxic") == 1)})


def g14_windowed_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders per month next to the (integer) monthly mean of their year."""
    g = cohort_trend(_t(spark, sf_dir, "orders"), "o_orderdate", ["year", "month"],
                     {"orders": K.n_rows()}, names={"year": "order_year", "month": "order_month"})
    return windowed_baseline(g, "order_year", "orders", "yearly_avg_orders")


def g15_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order value per nation as en-US currency text."""
    g = _orders_by_nation(spark, sf_dir)
    return g.select("n_name", K.currency("order_value").alias("order_value_usd"),
                    K.currency(K.exact_round("order_value", "orders", 2))
                    .alias("avg_order_value_usd"))


# --- oracles ------------------------------------------------------------------

_RETURNED = "l_returnflag = 'R'"
_FULFILLED = "o_orderstatus = 'F'"

_NATION_CTE = """WITH pc AS (SELECT o_custkey, SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS amt, COUNT(*) AS cnt
            FROM orders GROUP BY o_custkey),
bn AS (SELECT n_name, CAST(SUM(amt) AS DECIMAL(38,2)) AS order_value, CAST(SUM(cnt) AS BIGINT) AS orders
       FROM pc JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       GROUP BY n_name)
"""

SQL = {
    "g01_bucketize": f"""
SELECT CASE WHEN CAST(l_discount AS DECIMAL(10,4)) >= 0.07 THEN 'High discount' WHEN CAST(l_discount AS DECIMAL(10,4)) >= 0.03
            THEN 'Mid discount' ELSE 'Low discount' END AS discount_band, {S.N} AS lines,
       CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS revenue
FROM lineitem GROUP BY 1""",

    "g02_flag_rate": f"""
SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, {S.N} AS lines,
       {S.flag_rate("l_returnflag = 'R'")} AS returned_rate,
       {S.pct(f"SUM({S.flag(_RETURNED)})", 'COUNT(*)')} AS returned_pct
FROM lineitem GROUP BY 1""",

    "g03_segment_profile": f"""
SELECT o_orderpriority, c_mktsegment, {S.N} AS orders,
       {S.avg_x('CAST(o_totalprice AS DECIMAL(15,2))')} AS avg_total_price,
       {S.pct(f"SUM({S.flag(_FULFILLED)})", 'COUNT(*)')} AS fulfilled_pct
FROM orders JOIN customer ON o_custkey = c_custkey
GROUP BY o_orderpriority, c_mktsegment HAVING COUNT(*) >= 100""",

    "g04_portfolio_share": _NATION_CTE + f"""
SELECT n_name, order_value, orders,
       {S.pct('orders', 'SUM(orders) OVER ()')} AS orders_share_pct,
       {S.pct('CAST(order_value * 100 AS HUGEINT)', 'CAST(SUM(order_value) OVER () * 100 AS HUGEINT)')} AS value_share_pct
FROM bn""",

    "g05_cohort_trend": f"""
SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, CAST(quarter(o_orderdate) AS INTEGER) AS order_quarter,
       {S.N} AS orders, {S.avg_x('CAST(o_totalprice AS DECIMAL(15,2))')} AS avg_price,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS total_price
FROM orders GROUP BY 1, 2""",

    "g06_entity_rollup": f"""
WITH pu AS (SELECT user_id, {S.N} AS events, SUM(CAST(value AS DECIMAL(18,4))) AS total_value
            FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT events, {S.N} AS users, {S.avg_x('total_value')} AS avg_total_value FROM pu GROUP BY events""",

    "g07_concentration_curve": f"""
WITH pp AS (SELECT l_partkey, SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS rev FROM lineitem GROUP BY l_partkey),
br AS (SELECT p_brand, CAST(SUM(rev) AS DECIMAL(38,2)) AS brand_revenue
       FROM pp JOIN part ON l_partkey = p_partkey GROUP BY p_brand),
rk AS (SELECT *, {S.pct('CAST(brand_revenue * 10000 AS HUGEINT)', 'CAST(SUM(brand_revenue) OVER () * 10000 AS HUGEINT)')} AS revenue_share_pct,
              CAST(ROW_NUMBER() OVER (ORDER BY brand_revenue DESC, p_brand ASC) AS INTEGER) AS brand_rank
       FROM br)
SELECT p_brand, brand_revenue, revenue_share_pct, brand_rank,
       CAST(SUM(revenue_share_pct) OVER (ORDER BY brand_rank) AS DECIMAL(18,2)) AS cumulative_share_pct,
       CASE WHEN brand_rank > 15 THEN 'Other brands' WHEN brand_rank > 5 THEN 'Top 15 brands' ELSE 'Top 5 brands' END AS brand_tier
FROM rk""",

    "g08_multi_rank": _NATION_CTE + """,
av AS (SELECT *, CAST(order_value AS DOUBLE) / orders AS avg_order_value FROM bn)
SELECT n_name, order_value, orders, avg_order_value,
       CAST(RANK() OVER (ORDER BY order_value DESC) AS INTEGER) AS value_rank,
       CAST(RANK() OVER (ORDER BY orders DESC) AS INTEGER) AS count_rank,
       CAST(RANK() OVER (ORDER BY avg_order_value DESC) AS INTEGER) AS avg_value_rank
FROM av""",

    "g09_scenario_grid": """
WITH b AS (SELECT CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS gross,
                  CAST(SUM(CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount AS DECIMAL(10,4))) AS DECIMAL(38,6)) AS discounts
           FROM lineitem),
s AS (SELECT * FROM (VALUES ('Baseline', 1.00), ('Discount +10%', 1.10), ('Discount +50%', 1.50)) v(scenario, m))
SELECT scenario, gross, CAST(ROUND(discounts * m, 2) AS DECIMAL(38,2)) AS discounts,
       CAST(ROUND(gross - discounts * m, 2) AS DECIMAL(38,2)) AS net_revenue
FROM b CROSS JOIN s""",

    "g10_additive_score": f"""
WITH sc AS (SELECT CASE WHEN c_acctbal >= 7000 THEN 0 WHEN c_acctbal >= 3000 THEN 1 WHEN c_acctbal >= 0 THEN 2 ELSE 3 END + CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 2 WHEN 'MACHINERY' THEN 1 ELSE 0 END
                   + CASE WHEN c_nationkey >= 15 THEN 3 WHEN c_nationkey >= 5 THEN 2 ELSE 1 END AS score FROM customer)
SELECT CASE WHEN score > 3 THEN 'High' WHEN score > 1 THEN 'Medium' ELSE 'Low' END AS category, {S.N} AS customers,
       {S.avg_x('score')} AS avg_score, MIN(score) AS min_score, MAX(score) AS max_score
FROM sc GROUP BY 1""",

    "g11_rule_label": f"""
SELECT CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'Closed priority'
            WHEN o_orderstatus = 'F' THEN 'Closed' WHEN o_orderstatus = 'O' THEN 'Open'
            ELSE 'Partial' END AS order_class,
       {S.N} AS orders,
       CAST(SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS total_price
FROM orders GROUP BY 1""",

    "g12_elapsed": f"""
WITH d AS (SELECT o_orderpriority,
                  CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS days,
                  {S.month_boundaries('o_orderdate', 'l_shipdate')} AS months
           FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o_orderpriority, {S.N} AS lines, {S.avg_x('days')} AS avg_days, MAX(days) AS max_days,
       {S.iavg('months')} AS avg_months
FROM d GROUP BY o_orderpriority""",

    "g13_calibration": f"""
SELECT CASE WHEN n_chars >= 10000 THEN 'long' WHEN n_chars >= 1000 THEN 'medium' ELSE 'short' END AS length_band, {S.N} AS docs,
       {S.avg_x('n_chars')} AS avg_chars,
       {S.flag_rate('quality = 1')} AS quality_rate, {S.flag_rate('toxic = 1')} AS toxic_rate
FROM labels JOIN documents USING (doc_id) GROUP BY 1""",

    "g14_windowed_baseline": f"""
WITH m AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS order_year, CAST(month(o_orderdate) AS INTEGER) AS order_month,
                  {S.N} AS orders FROM orders GROUP BY 1, 2)
SELECT order_year, order_month, orders,
       {S.iavg_over('orders', 'PARTITION BY order_year')} AS yearly_avg_orders
FROM m""",

    "g15_currency": _NATION_CTE + f"""
SELECT n_name, {S.currency('order_value')} AS order_value_usd,
       {S.currency(S.half_up('CAST(order_value * 100 AS HUGEINT)', 'orders * 100'))} AS avg_order_value_usd
FROM bn""",
}

FUNCS = {name: fn for name, fn in list(globals().items())
         if name.startswith("g") and name[1:3].isdigit() and callable(fn)}
