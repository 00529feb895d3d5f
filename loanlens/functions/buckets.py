"""Bucket ladders (first matching rule wins; the default also catches NULL).

A ladder is a list of ``(op, operand, label)`` rules plus a default label.
``op`` is one of ``< <= > >= = between in``. The oracles do not use the
ladders: they state cuts and labels as literals of their own.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class Ladder:
    rules: tuple
    default: object

    def labels(self) -> list:
        return [r[2] for r in self.rules] + [self.default]


def _lit(v) -> Column:
    """Literal of a rule operand or label (Decimal operands stay exact decimals)."""
    return F.lit(v)


def rule_predicate(x: Column, op: str, operand) -> Column:
    if op == "<":
        return x < _lit(operand)
    if op == "<=":
        return x <= _lit(operand)
    if op == ">":
        return x > _lit(operand)
    if op == ">=":
        return x >= _lit(operand)
    if op == "=":
        return x == _lit(operand)
    if op == "between":
        lo, hi = operand
        return x.between(_lit(lo), _lit(hi))
    if op == "in":
        return x.isin(*operand)
    raise ValueError(op)


def bucketize(x, ladder: Ladder) -> Column:
    """Chained ``when`` for a ladder; NULL input falls through to the default."""
    x = c(x)
    out = None
    for op, operand, label in ladder.rules:
        cond = rule_predicate(x, op, operand)
        out = F.when(cond, _lit(label)) if out is None else out.when(cond, _lit(label))
    return out.otherwise(_lit(ladder.default))


def ordinal(x, labels: list, default: int | None = None) -> Column:
    """Sort position of a label (``CASE label WHEN ... THEN 1 ...``)."""
    x = c(x)
    out = None
    for i, lab in enumerate(labels, start=1):
        out = F.when(x == lab, F.lit(i)) if out is None else out.when(x == lab, F.lit(i))
    return out.otherwise(F.lit(default)) if default is not None else out


def _d(v: str) -> Decimal:
    return Decimal(v)


# === fixed values of the reference ==========================================
# Statuses, thresholds, minimum group sizes, cut points and labels as the
# reference states them (label text as written: U+2013 EN DASH, U+2264
# LESS-THAN OR EQUAL TO and doubled spaces are part of the labels).

BAD_STATUSES = ("Defaulted", "Chargedoff")
CLOSED_STATUSES = ("Completed", "Chargedoff", "Defaulted")
STATUS_CURRENT = "Current"
STATUS_COMPLETED = "Completed"
PAST_DUE_PREFIX = "Past Due"
SNAPSHOT_SINCE = _dt.date(2009, 12, 31)
OCCUPATION_MIN_LOANS = 100
SCORE_EMPLOYMENT_MIN_LOANS = 50
REPEAT_BORROWER_MAX_LOANS = 10
DELINQ_MIN_LOANS = 5
STATE_MIN_LOANS = 5
SCORECARD_MIN_LOANS = 5
TERM_COMPARED = (36, 60)
MATRIX_TERM = 36
UTILIZATION_RANGE = (0, 1)
FULLY_FUNDED_MAX = Decimal("1.0")
PAST_DUE_PAYMENT_FACTOR = Decimal("0.5")
PROFILE_LOW_BAND = (Decimal("0.01"), Decimal("0.25"))
PROFILE_MEDIUM_BAND = (Decimal("0.26"), Decimal("0.50"))
SCORECARD_LOW_RULE = (720, Decimal("0.30"), 24)    # score midpoint >=, DTI <=, employment months >=
SCORECARD_MEDIUM_RULE = (640, Decimal("0.50"))     # score midpoint >=, DTI <=

DTI_SEGMENT = Ladder((
    ("<", _d("0.20"), "Low DTI  (< 20%)"),
    ("<", _d("0.35"), "Mid DTI  (20–35%)"),
), "High DTI (> 35%)")

INVESTOR_TIER = Ladder((
    ("=", 1, "1 Investor"),
    ("between", (2, 10), "2–10 Investors"),
    ("between", (11, 50), "11–50 Investors"),
    ("between", (51, 100), "51–100 Investors"),
    ("between", (101, 500), "101–500 Investors"),
), "500+ Investors")

LOAN_OUTCOME = Ladder((
    ("=", "Completed", "Completed"),
    ("=", "Current", "Current"),
    ("in", ("Defaulted", "Chargedoff"), "Defaulted / Charged-Off"),
), "Other")

DTI_RANGE = Ladder((
    ("<=", _d("0.20"), "0–20%  (Low)"),
    ("<=", _d("0.40"), "21–40% (Mid)"),
    ("<=", _d("0.60"), "41–60% (High)"),
), "60%+   (Critical)")

MONTH_QUARTER = Ladder((
    ("in", (1, 2, 3), "Q1"),
    ("in", (4, 5, 6), "Q2"),
    ("in", (7, 8, 9), "Q3"),
), "Q4")

INVESTOR_RETURN_TIER = Ladder((
    (">=", 500, "500+ Investors"),
    (">=", 200, "200–499 Investors"),
    (">=", 100, "100–199 Investors"),
    (">=", 50, "50–99 Investors"),
), "<50 Investors")

STATE_TIER = Ladder((
    ("<=", 10, "Top 10 States"),
    ("<=", 25, "Top 25 States"),
), "Remainder")

UTILIZATION = Ladder((
    ("<=", _d("0.10"), "0–10%"),
    ("<=", _d("0.30"), "11–30%"),
    ("<=", _d("0.50"), "31–50%"),
    ("<=", _d("0.70"), "51–70%"),
    ("<=", _d("0.90"), "71–90%"),
), "91–100%+")

CURRENT_DELINQ = Ladder((
    ("=", 0, "0 Delinquencies"),
    ("<=", 2, "1–2 Delinquencies"),
    ("<=", 5, "3–5 Delinquencies"),
), "6+ Delinquencies")

PAST_DELINQ = Ladder((
    ("=", 0, "0 Past Delinquencies"),
    ("<=", 5, "1–5 Past Delinquencies"),
    ("<=", 10, "6–10 Past Delinquencies"),
), "11+ Past Delinquencies")

INVESTOR_CATEGORY = Ladder((
    ("<=", 10, "1–10 Investors"),
    ("<=", 50, "11–50 Investors"),
    ("<=", 100, "51–100 Investors"),
    ("<=", 200, "101–200 Investors"),
), "200+ Investors")

STATE_RISK = Ladder((
    ("<=", 5, "High Risk"),
    ("<=", 15, "Medium Risk"),
), "Low Risk")

INCOME_CATEGORY = Ladder((
    ("in", ("Not employed", "$0"), "No Income"),
    ("=", "$1-24,999", "Low Income"),
    ("=", "$25,000-49,999", "Lower Middle"),
    ("=", "$50,000-74,999", "Middle Income"),
    ("=", "$75,000-99,999", "Upper Middle"),
    ("=", "$100,000+", "High Income"),
), "Not Displayed")

# payment-to-income: applied to the ratio; rows with income <= 0 are handled
# by the caller (their ratio is NULL and they are dropped before grouping)
PTI_BUCKET = Ladder((
    ("<=", 15, "Very Low (≤15%)"),
    ("<=", 25, "Low (16–25%)"),
    ("<=", 35, "Moderate (26–35%)"),
    ("<=", 45, "High (36–45%)"),
), "Very High (>45%)")
PTI_NO_INCOME = "No Income"

CREDIT_TIER = Ladder((
    (">=", 720, "720+ (Prime)"),
    (">=", 680, "680–719 (Near-Prime)"),
    (">=", 640, "640–679 (Subprime)"),
), "Below 640 (Deep Sub)")

DTI_TIER = Ladder((
    ("<", _d("0.30"), "Low DTI"),
    ("<", _d("0.50"), "Mid DTI"),
), "High DTI")

DELINQUENCY_STATUS = Ladder((
    ("=", 0, "Clean"),
), "Delinquent")

# composite score factors (points)
CREDIT_FACTOR = Ladder((
    (">=", 760, 0), (">=", 720, 1), (">=", 680, 2), (">=", 640, 3),
), 4)
DTI_FACTOR = Ladder((
    ("<", _d("0.20"), 0), ("<", _d("0.35"), 1), ("<", _d("0.50"), 2), ("<", _d("0.70"), 3),
), 4)
DELINQUENCY_FACTOR = Ladder((
    ("=", 0, 0), ("<=", 2, 1), ("<=", 5, 2),
), 3)
PUBLIC_RECORDS_FACTOR = Ladder((
    ("=", 0, 0), ("=", 1, 2),
), 3)
EMPLOYMENT_FACTOR = Ladder((
    ("=", "Employed", 0), ("=", "Self-employed", 1), ("=", "Not employed", 3),
), 1)
COMPOSITE_SCORE_DIVISOR = 20
COMPOSITE_CATEGORY = Ladder((
    ("<=", 3, "Low Risk"),
    ("<=", 8, "Medium Risk"),
    ("<=", 13, "High Risk"),
), "Very High Risk")

# scorecard dimensions
SCORE_CATEGORY = Ladder((
    (">=", 720, "Excellent (720+)"),
    (">=", 680, "Good (680–719)"),
    (">=", 640, "Fair (640–679)"),
), "Poor (<640)")
DTI_CATEGORY = Ladder((
    ("<=", _d("0.20"), "Low DTI (≤20%)"),
    ("<=", _d("0.40"), "Medium DTI (21–40%)"),
), "High DTI (>40%)")
EMPLOYMENT_STABILITY = Ladder((
    (">=", 60, "Very Stable (5+ yrs)"),
    (">=", 24, "Stable (2–5 yrs)"),
    (">=", 12, "Some Stability (1–2 yrs)"),
), "Limited (<1 yr)")
SCORECARD_INCOME = Ladder((
    ("=", "$100,000+", "High Income"),
    ("in", ("$75,000-99,999", "$50,000-74,999"), "Middle Income"),
    ("=", "$25,000-49,999", "Lower Middle"),
    ("=", "$1-24,999", "Low Income"),
), "No/Minimal Income")
HOUSING_STATUS = Ladder((
    ("=", "True", "Homeowner"),
), "Renter")
SCORECARD_TOP_INCOMES = ("$50,000-74,999", "$75,000-99,999", "$100,000+")
INCOME_NOT_DISPLAYED = "Not displayed"
OCCUPATION_OTHER = "Other"

# borrower progression profile labels
PROFILE_PERFECT = "Perfect-Performing"
PROFILE_CURRENT = "Currently-Performing"
PROFILE_LOW = "Low-Risk"
PROFILE_MEDIUM = "Medium-Risk"
PROFILE_HIGH = "High-Risk"

# scorecard rule labels
RULE_LOW, RULE_MEDIUM, RULE_HIGH = "Low Risk", "Medium Risk", "High Risk"

# term labels (simple CASE without ELSE)
TERM_LABELS = ((36, "Medium Term"), (60, "Long Term"))

# ORDER BY ladders: label -> position (unlisted labels take the last position)
UTILIZATION_ORDER = ["0–10%", "11–30%", "31–50%", "51–70%", "71–90%"]
INCOME_ORDER = ["High Income", "Upper Middle", "Middle Income", "Lower Middle",
                "Low Income", "No Income"]
PTI_ORDER = ["Very Low (≤15%)", "Low (16–25%)", "Moderate (26–35%)", "High (36–45%)",
             "Very High (>45%)"]
COMPOSITE_ORDER = ["Low Risk", "Medium Risk", "High Risk", "Very High Risk"]

# stress scenarios: label and default/loss multiplier
STRESS_SCENARIOS = (
    ("Baseline (Actual)", None),
    ("Mild Stress (+5% Defaults)", "1.05"),
    ("Moderate Stress (+15% Defaults)", "1.15"),
    ("Severe Stress (+25% Defaults)", "1.25"),
)
# ===========================================================================
