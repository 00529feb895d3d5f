"""Ladder edges, NULL handling and exact label text, as literal values."""
from decimal import Decimal

import pytest
from pyspark.sql import types as T

from loanlens.functions import buckets as B
from loanlens.functions.buckets import bucketize, ordinal

# name: pairs of (value, label): each edge from both sides; None is NULL
RATE = T.DecimalType(10, 4)
EDGES = {
    "DTI_SEGMENT": (RATE, [("0.1999", "Low DTI  (< 20%)"), ("0.2", "Mid DTI  (20–35%)"), ("0.3499", "Mid DTI  (20–35%)"),
                           ("0.35", "High DTI (> 35%)"), (None, "High DTI (> 35%)")]),
    "DTI_RANGE": (RATE, [("0.2", "0–20%  (Low)"), ("0.2001", "21–40% (Mid)"), ("0.4", "21–40% (Mid)"), ("0.4001", "41–60% (High)"),
                         ("0.6", "41–60% (High)"), ("0.6001", "60%+   (Critical)")]),
    "UTILIZATION": (RATE, [("0.1", "0–10%"), ("0.1001", "11–30%"), ("0.3", "11–30%"), ("0.3001", "31–50%"), ("0.5", "31–50%"),
                           ("0.5001", "51–70%"), ("0.7", "51–70%"), ("0.7001", "71–90%"), ("0.9", "71–90%"), ("0.9001", "91–100%+")]),
    "DTI_TIER": (RATE, [("0.2999", "Low DTI"), ("0.3", "Mid DTI"), ("0.4999", "Mid DTI"), ("0.5", "High DTI")]),
    "DTI_FACTOR": (RATE, [("0.1999", 0), ("0.2", 1), ("0.3499", 1), ("0.35", 2), ("0.4999", 2), ("0.5", 3), ("0.6999", 3), ("0.7", 4), (None, 4)]),
    "DTI_CATEGORY": (RATE, [("0.2", "Low DTI (≤20%)"), ("0.2001", "Medium DTI (21–40%)"), ("0.4", "Medium DTI (21–40%)"),
                            ("0.4001", "High DTI (>40%)")]),
    "INVESTOR_TIER": (T.IntegerType(), [(0, "500+ Investors"), (1, "1 Investor"), (2, "2–10 Investors"), (10, "2–10 Investors"),
                                        (11, "11–50 Investors"), (50, "11–50 Investors"), (51, "51–100 Investors"), (100, "51–100 Investors"),
                                        (101, "101–500 Investors"), (500, "101–500 Investors"), (501, "500+ Investors")]),
    "INVESTOR_RETURN_TIER": (T.IntegerType(), [(500, "500+ Investors"), (499, "200–499 Investors"), (200, "200–499 Investors"),
                                               (199, "100–199 Investors"), (100, "100–199 Investors"), (99, "50–99 Investors"),
                                               (50, "50–99 Investors"), (49, "<50 Investors")]),
    "INVESTOR_CATEGORY": (T.IntegerType(), [(10, "1–10 Investors"), (11, "11–50 Investors"), (50, "11–50 Investors"),
                                            (51, "51–100 Investors"), (100, "51–100 Investors"), (101, "101–200 Investors"),
                                            (200, "101–200 Investors"), (201, "200+ Investors")]),
    "CURRENT_DELINQ": (T.IntegerType(), [(0, "0 Delinquencies"), (1, "1–2 Delinquencies"), (2, "1–2 Delinquencies"), (3, "3–5 Delinquencies"),
                                         (5, "3–5 Delinquencies"), (6, "6+ Delinquencies")]),
    "PAST_DELINQ": (T.IntegerType(), [(0, "0 Past Delinquencies"), (1, "1–5 Past Delinquencies"), (5, "1–5 Past Delinquencies"),
                                      (6, "6–10 Past Delinquencies"), (10, "6–10 Past Delinquencies"), (11, "11+ Past Delinquencies")]),
    "CREDIT_TIER": (T.IntegerType(), [(720, "720+ (Prime)"), (719, "680–719 (Near-Prime)"), (680, "680–719 (Near-Prime)"),
                                      (679, "640–679 (Subprime)"), (640, "640–679 (Subprime)"), (639, "Below 640 (Deep Sub)")]),
    "CREDIT_FACTOR": (T.IntegerType(), [(760, 0), (759, 1), (720, 1), (719, 2), (680, 2), (679, 3), (640, 3), (639, 4)]),
    "DELINQUENCY_FACTOR": (T.IntegerType(), [(0, 0), (1, 1), (2, 1), (3, 2), (5, 2), (6, 3), (None, 3)]),
    "PUBLIC_RECORDS_FACTOR": (T.IntegerType(), [(0, 0), (1, 2), (2, 3), (None, 3)]),
    "EMPLOYMENT_FACTOR": (T.StringType(), [("Employed", 0), ("Self-employed", 1), ("Not employed", 3), ("Full-time", 1), (None, 1)]),
    "EMPLOYMENT_STABILITY": (T.IntegerType(), [(60, "Very Stable (5+ yrs)"), (59, "Stable (2–5 yrs)"), (24, "Stable (2–5 yrs)"),
                                               (23, "Some Stability (1–2 yrs)"), (12, "Some Stability (1–2 yrs)"), (11, "Limited (<1 yr)")]),
    "COMPOSITE_CATEGORY": (T.IntegerType(), [(3, "Low Risk"), (4, "Medium Risk"), (8, "Medium Risk"), (9, "High Risk"), (13, "High Risk"),
                                             (14, "Very High Risk")]),
    "STATE_TIER": (T.IntegerType(), [(10, "Top 10 States"), (11, "Top 25 States"), (25, "Top 25 States"), (26, "Remainder")]),
    "STATE_RISK": (T.IntegerType(), [(5, "High Risk"), (6, "Medium Risk"), (15, "Medium Risk"), (16, "Low Risk")]),
    "MONTH_QUARTER": (T.IntegerType(), [(1, "Q1"), (3, "Q1"), (4, "Q2"), (6, "Q2"), (7, "Q3"), (9, "Q3"), (10, "Q4"), (None, "Q4")]),
    "PTI_BUCKET": (T.DecimalType(12, 6), [("15", "Very Low (≤15%)"), ("15.000001", "Low (16–25%)"), ("25", "Low (16–25%)"),
                                          ("25.000001", "Moderate (26–35%)"), ("35", "Moderate (26–35%)"), ("35.000001", "High (36–45%)"),
                                          ("45", "High (36–45%)"), ("45.000001", "Very High (>45%)")]),
    "SCORE_CATEGORY": (T.DecimalType(10, 1), [("720", "Excellent (720+)"), ("719.5", "Good (680–719)"), ("680", "Good (680–719)"),
                                              ("679.5", "Fair (640–679)"), ("640", "Fair (640–679)"), ("639.5", "Poor (<640)")]),
    "DELINQUENCY_STATUS": (T.IntegerType(), [(0, "Clean"), (1, "Delinquent")]),
    "LOAN_OUTCOME": (T.StringType(), [("Completed", "Completed"), ("Current", "Current"), ("Defaulted", "Defaulted / Charged-Off"),
                                      ("Chargedoff", "Defaulted / Charged-Off"), ("Cancelled", "Other"), (None, "Other")]),
    "HOUSING_STATUS": (T.StringType(), [("True", "Homeowner"), ("False", "Renter"), (None, "Renter")]),
    "INCOME_CATEGORY": (T.StringType(), [("Not employed", "No Income"), ("$0", "No Income"), ("$1-24,999", "Low Income"),
                                         ("$25,000-49,999", "Lower Middle"), ("$50,000-74,999", "Middle Income"),
                                         ("$75,000-99,999", "Upper Middle"), ("$100,000+", "High Income"), ("x", "Not Displayed")]),
    "SCORECARD_INCOME": (T.StringType(), [("$100,000+", "High Income"), ("$75,000-99,999", "Middle Income"), ("$50,000-74,999", "Middle Income"),
                                          ("$25,000-49,999", "Lower Middle"), ("$1-24,999", "Low Income"), ("$0", "No/Minimal Income")]),
}


def test_every_ladder_has_its_edges():
    assert set(EDGES) == {k for k, v in vars(B).items() if isinstance(v, B.Ladder)}


@pytest.mark.parametrize("name", sorted(EDGES))
def test_ladder_edges(spark, name):
    kind, pairs = EDGES[name]
    exact = isinstance(kind, T.DecimalType)
    df = spark.createDataFrame([(Decimal(v) if exact and v is not None else v,) for v, _ in pairs],
                               T.StructType([T.StructField("x", kind)])).coalesce(1)
    assert [r[0] for r in df.select(bucketize("x", getattr(B, name))).collect()] == [label for _, label in pairs]


def test_term_labels_and_orders():
    assert B.TERM_LABELS == ((36, "Medium Term"), (60, "Long Term"))
    assert B.COMPOSITE_ORDER == ["Low Risk", "Medium Risk", "High Risk", "Very High Risk"]
    assert (B.PROFILE_LOW_BAND, B.PROFILE_MEDIUM_BAND) == ((Decimal("0.01"), Decimal("0.25")), (Decimal("0.26"), Decimal("0.50")))
    assert B.SCORECARD_LOW_RULE == (720, Decimal("0.30"), 24) and B.SCORECARD_MEDIUM_RULE == (640, Decimal("0.50"))


def test_dti_segment_edges(spark):
    df = spark.createDataFrame([(Decimal(v),) for v in ("0.1999", "0.2000", "0.3499", "0.3500")],
                               T.StructType([T.StructField("x", T.DecimalType(10, 4))]))
    got = [r[0] for r in df.select(bucketize("x", B.DTI_SEGMENT)).collect()]
    assert got == ["Low DTI  (< 20%)", "Mid DTI  (20–35%)", "Mid DTI  (20–35%)", "High DTI (> 35%)"]


def test_investor_tier_zero_and_negative_fall_to_500_plus(spark):
    df = spark.createDataFrame([(0,), (-3,), (1,), (500,), (501,)], "x int")
    got = [r[0] for r in df.select(bucketize("x", B.INVESTOR_TIER)).collect()]
    assert got == ["500+ Investors", "500+ Investors", "1 Investor", "101–500 Investors",
                   "500+ Investors"]


def test_null_month_is_q4_and_null_employment_scores_one(spark):
    df = spark.createDataFrame([(None, None)], "m int, e string")
    r = df.select(bucketize("m", B.MONTH_QUARTER), bucketize("e", B.EMPLOYMENT_FACTOR)).first()
    assert r[0] == "Q4" and r[1] == 1


def test_labels_use_en_dash_and_leq():
    assert "–" in B.DTI_SEGMENT.rules[1][2]
    assert "≤" in B.PTI_BUCKET.rules[0][2]
    assert B.DTI_RANGE.default == "60%+   (Critical)"


def test_text_ladders(spark):
    df = spark.createDataFrame([("$0",), ("Not employed",), ("$100,000+",), ("weird",), (None,)],
                               "x string")
    got = [tuple(r) for r in df.select(bucketize("x", B.INCOME_CATEGORY),
                                   bucketize("x", B.SCORECARD_INCOME)).collect()]
    assert got[0] == ("No Income", "No/Minimal Income")
    assert got[2] == ("High Income", "High Income")
    assert got[3] == ("Not Displayed", "No/Minimal Income")
    assert got[4] == ("Not Displayed", "No/Minimal Income")


def test_ordinal(spark):
    df = spark.createDataFrame([("91–100%+",), ("0–10%",)], "x string")
    got = [r[0] for r in df.select(ordinal("x", B.UTILIZATION_ORDER, 6)).collect()]
    assert got == [6, 1]
