"""Tier 2: bucketed segment profiles, calibration, minimum-sample filters (s07-s15)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.functions import buckets as B
from loanlens.functions import canon as K
from loanlens.functions.buckets import bucketize
from loanlens.functions.canon import D
from loanlens.operators.profile import calibration, profile_with_total, segment_profile
from loanlens.operators.output import sorted_by
from loanlens.plans import sqlkit as S

OCCUPATION_MIN_LOANS = B.OCCUPATION_MIN_LOANS


def s07_rating_vs_default(loans: DataFrame) -> DataFrame:
    """Per rating: count, average APR, realized default rate, average lender yield."""
    return (segment_profile(loans, ["risk_rating"], {
        "avg_borrower_apr": K.avg_x("borrower_apr"),
        "default_rate": K.flag_rate(K.is_bad()),
        "avg_lender_yield": K.avg_x("lender_yield"),
    }, count_name="total_loans", where=F.col("risk_rating").isNotNull())
        .transform(sorted_by("risk_rating")))


def s08_expected_vs_realized_loss(loans: DataFrame) -> DataFrame:
    """Per rating (NULL kept): expected loss vs realized loss ratio.

    The realized ratio is 0 for good loans and loss / amount for bad ones;
    a bad loan with a zero amount gives NULL and leaves the average.
    """
    realized = K.ratio6(F.when(K.is_bad(), K.guarded_div("lp_gross_principal_loss",
                                                         "loan_original_amount"))
                        .otherwise(F.lit(0.0)))
    return (calibration(loans, "risk_rating",
                        {"avg_estimated_loss": K.avg_x("estimated_loss")},
                        {"avg_realized_loss_ratio": K.avg_x(realized)})
            .transform(sorted_by("risk_rating")))


def s09_friends_investment(loans: DataFrame) -> DataFrame:
    """Per friends-investment count: count, average APR, default rate."""
    return (segment_profile(loans, ["investment_from_friends_count"], {
        "avg_borrower_apr": K.avg_x("borrower_apr"),
        "default_rate": K.flag_rate(K.is_bad()),
    }, count_name="total_loans").transform(sorted_by("investment_from_friends_count")))


def s10_dti_segment(loans: DataFrame) -> DataFrame:
    """Per DTI segment (three bands): count, average APR, default rate."""
    dti = F.col("debt_to_income_ratio")
    return segment_profile(loans.filter(dti.isNotNull())
                           .withColumn("dti_segment", bucketize(dti, B.DTI_SEGMENT)),
                           ["dti_segment"], {
                               "avg_borrower_apr": K.avg_x("borrower_apr"),
                               "default_rate": K.flag_rate(K.is_bad()),
                           }, count_name="total_loans")


def s11_term_optimization(loans: DataFrame) -> DataFrame:
    """Per term: amounts, rates, default and completion rates, payments, investors."""
    pay = F.col("monthly_loan_payment")
    return (segment_profile(loans, ["term"], {
        "avg_loan_amount": K.avg_x("loan_original_amount"),
        "avg_borrower_rate": K.avg_x(F.col("borrower_rate").cast(D(10, 4))),
        "avg_borrower_apr": K.avg_x(F.col("borrower_apr").cast(D(10, 4))),
        "default_rate_pct": K.bad_pct(),
        "completion_rate_pct": K.pct(K.count_if(K.is_status(B.STATUS_COMPLETED)), K.n_rows()),
        "avg_monthly_payment": K.avg_x(pay),
        "total_monthly_payments": F.sum(pay).cast(D(38, 2)),
        "avg_investors_per_loan": K.avg_x("investors"),
    }, count_name="total_loans", where=F.col("term").isNotNull()).transform(sorted_by("term")))


def s12_homeowner_occupation(loans: DataFrame, min_loans: int = OCCUPATION_MIN_LOANS) -> DataFrame:
    """Per homeowner flag x occupation (not 'Other'), groups with >= ``min_loans``."""
    occ = F.col("occupation")
    return (segment_profile(loans, ["is_borrower_homeowner", "occupation"], {
        "default_rate_pct": K.bad_pct(),
        "avg_loan_amount": K.avg_x("loan_original_amount"),
        "avg_interest_rate": K.avg_x(F.col("borrower_rate").cast(D(10, 4))),
        "avg_credit_score": K.avg_x("credit_score_range_lower"),
        "avg_dti": K.avg_x(F.col("debt_to_income_ratio").cast(D(10, 2))),
    }, count_name="loan_count", min_count=min_loans,
        where=occ.isNotNull() & (occ != B.OCCUPATION_OTHER))
        .transform(sorted_by(F.desc("default_rate_pct"))))


def s13_investor_concentration(loans: DataFrame) -> DataFrame:
    """Per investor tier: share of **all** loans (unfiltered denominator), outcomes.

    Loans with no investor count take part in the denominator only; the
    total comes from the same aggregation (one scan).
    """
    amt = F.col("loan_original_amount")
    inv = F.col("investors")
    g = profile_with_total(
        loans.withColumn("investor_tier", bucketize(inv, B.INVESTOR_TIER)),
        ["investor_tier"], keep=inv.isNotNull(),
        measures={
            "avg_loan_amount": K.avg_x(amt),
            "avg_percent_funded": K.avg_x("percent_funded"),
            "default_rate_pct": K.bad_pct(),
            "avg_borrower_rate": K.avg_x(F.col("borrower_rate").cast(D(10, 4))),
            "total_loan_volume": F.sum(amt).cast(D(38, 2)),
        },
        totals={"_all_loans": "loan_count"}, count_name="loan_count")
    return (g.select("investor_tier", "loan_count",
                     K.pct("loan_count", "_all_loans").alias("portfolio_share_pct"),
                     "avg_loan_amount", "avg_percent_funded", "default_rate_pct",
                     "avg_borrower_rate", "total_loan_volume")
            .transform(sorted_by(F.desc("loan_count"))))


def s14_loss_recovery(loans: DataFrame) -> DataFrame:
    """Per outcome: principal losses, recoveries and recovery rate."""
    gross = F.col("lp_gross_principal_loss").cast(D(15, 2))
    net = F.col("lp_net_principal_loss").cast(D(15, 2))
    rec = F.col("lp_non_principal_recovery_payments").cast(D(15, 2))
    g = segment_profile(
        loans.withColumn("loan_outcome", bucketize("loan_status", B.LOAN_OUTCOME)),
        ["loan_outcome"], {
            "total_original_amount": F.sum("loan_original_amount").cast(D(38, 2)),
            "avg_gross_principal_loss": K.avg_x(gross),
            "avg_net_principal_loss": K.avg_x(net),
            "total_gross_loss": F.sum(gross).cast(D(38, 2)),
            "total_net_loss": F.sum(net).cast(D(38, 2)),
            "avg_recoveries": K.avg_x(rec),
            "recovery_rate_pct": K.ravg_ratio(rec, gross, 2),
            "avg_investors": K.avg_x("investors"),
        }, count_name="loan_count", where=F.col("lp_gross_principal_loss").isNotNull())
    return g.transform(sorted_by(F.desc("loan_count")))


def s15_risk_return_rank(loans: DataFrame) -> DataFrame:
    """Per rating x term (NULL groups kept): lender yield minus default rate."""
    g = segment_profile(loans, ["risk_rating", "term"], {
        "avg_lender_yield": K.avg_x("lender_yield"),
        "default_rate": K.flag_rate(K.is_bad()),
    }, count_name="total_loans")
    return (g.withColumn("risk_adjusted_return", F.col("avg_lender_yield") - F.col("default_rate"))
            .transform(sorted_by(F.desc("risk_adjusted_return"))))


# --- oracles ------------------------------------------------------------------

_BADRATE = S.flag_rate(S.BAD)

SQL = {
    "s07_rating_vs_default": S.over_loans(f"""
SELECT risk_rating, {S.N} AS total_loans, {S.avg_x('borrower_apr')} AS avg_borrower_apr,
       {_BADRATE} AS default_rate, {S.avg_x('lender_yield')} AS avg_lender_yield
FROM loan WHERE risk_rating IS NOT NULL GROUP BY risk_rating"""),

    "s08_expected_vs_realized_loss": S.over_loans(f"""
SELECT risk_rating, {S.avg_x('estimated_loss')} AS avg_estimated_loss,
       {S.avg_x(S.ratio6(f"CASE WHEN {S.BAD} THEN {S.guarded_div('lp_gross_principal_loss', 'loan_original_amount')} ELSE 0 END"))} AS avg_realized_loss_ratio
FROM loan GROUP BY risk_rating"""),

    "s09_friends_investment": S.over_loans(f"""
SELECT investment_from_friends_count, {S.N} AS total_loans,
       {S.avg_x('borrower_apr')} AS avg_borrower_apr, {_BADRATE} AS default_rate
FROM loan GROUP BY investment_from_friends_count"""),

    "s11_term_optimization": S.over_loans(f"""
SELECT term, {S.N} AS total_loans,
       {S.avg_x('loan_original_amount')} AS avg_loan_amount,
       {S.avg_x('CAST(borrower_rate AS DECIMAL(10,4))')} AS avg_borrower_rate,
       {S.avg_x('CAST(borrower_apr AS DECIMAL(10,4))')} AS avg_borrower_apr,
       {S.BAD_PCT} AS default_rate_pct,
       {S.pct(f"COUNT(*) FILTER ({S.COMPLETED})", 'COUNT(*)')} AS completion_rate_pct,
       {S.avg_x('monthly_loan_payment')} AS avg_monthly_payment,
       CAST(SUM(monthly_loan_payment) AS DECIMAL(38,2)) AS total_monthly_payments,
       {S.avg_x('investors')} AS avg_investors_per_loan
FROM loan WHERE term IS NOT NULL GROUP BY term"""),

    "s12_homeowner_occupation": S.over_loans(f"""
SELECT is_borrower_homeowner, occupation, {S.N} AS loan_count,
       {S.BAD_PCT} AS default_rate_pct,
       {S.avg_x('loan_original_amount')} AS avg_loan_amount,
       {S.avg_x('CAST(borrower_rate AS DECIMAL(10,4))')} AS avg_interest_rate,
       {S.avg_x('credit_score_range_lower')} AS avg_credit_score,
       {S.avg_x('CAST(debt_to_income_ratio AS DECIMAL(10,2))')} AS avg_dti
FROM loan WHERE occupation IS NOT NULL AND occupation <> 'Other'
GROUP BY is_borrower_homeowner, occupation HAVING COUNT(*) >= 100"""),

    "s15_risk_return_rank": S.over_loans(f"""
SELECT risk_rating, term, {S.N} AS total_loans,
       {S.avg_x('lender_yield')} AS avg_lender_yield, {_BADRATE} AS default_rate,
       {S.avg_x('lender_yield')} - {_BADRATE} AS risk_adjusted_return
FROM loan GROUP BY risk_rating, term"""),
}

FUNCS = {
    "s07_rating_vs_default": s07_rating_vs_default,
    "s08_expected_vs_realized_loss": s08_expected_vs_realized_loss,
    "s09_friends_investment": s09_friends_investment,
    "s10_dti_segment": s10_dti_segment,
    "s11_term_optimization": s11_term_optimization,
    "s12_homeowner_occupation": s12_homeowner_occupation,
    "s13_investor_concentration": s13_investor_concentration,
    "s14_loss_recovery": s14_loss_recovery,
    "s15_risk_return_rank": s15_risk_return_rank,
}
