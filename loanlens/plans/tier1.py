"""Tier 1: row snapshots and single-key profiles (s01-s06).

Each analysis is a ``DataFrame -> DataFrame`` function over the loan table
with the reference's constants as keyword defaults, next to its SQL oracle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanlens.functions import buckets as B
from loanlens.functions import canon as K
from loanlens.functions.canon import D
from loanlens.operators.profile import segment_profile
from loanlens.operators.output import sorted_by
from loanlens.plans import sqlkit as S

SNAPSHOT_SINCE = B.SNAPSHOT_SINCE
SNAPSHOT_IN_RANGE = dt.date(1998, 1, 5)


def s01_post2009_snapshot(loans: DataFrame, since: dt.date = SNAPSHOT_SINCE) -> DataFrame:
    """Loans originated on/after ``since``: date, amount, payments, est. return/loss."""
    return (loans.filter(F.col("loan_origination_date") >= F.lit(since))
            .select("loan_origination_date", "loan_original_amount", "lp_customer_payments",
                    "estimated_return", "estimated_loss"))


def s01_snapshot_in_range(loans: DataFrame) -> DataFrame:
    """The snapshot with a cutoff inside the data, a date on which loans originate."""
    return s01_post2009_snapshot(loans, SNAPSHOT_IN_RANGE)


def s02_net_return(loans: DataFrame) -> DataFrame:
    """Closed loans: payments minus gross principal loss (NULL if either is NULL)."""
    return (loans.filter(F.col("loan_status").isin(*B.CLOSED_STATUSES))
            .select("loan_number", "loan_original_amount", "lender_yield", "lp_customer_payments",
                    "lp_gross_principal_loss",
                    (F.col("lp_customer_payments") - F.col("lp_gross_principal_loss"))
                    .cast(D(16, 2)).alias("net_return")))


def s03_time_to_default(loans: DataFrame) -> DataFrame:
    """Bad loans with a closed date: days from origination to closure (may be < 0)."""
    return (loans.filter(K.is_bad() & F.col("closed_date").isNotNull())
            .select("loan_number", "loan_origination_date", "closed_date",
                    K.day_diff("loan_origination_date", "closed_date").cast("int")
                    .alias("days_to_default"),
                    "loan_status"))


def s04_status_summary(loans: DataFrame) -> DataFrame:
    """Per status: counts, distinct borrowers, amount stats, share of all loans.

    The share's denominator (all rows) is the sum of the group counts, so
    the table is scanned once instead of twice.
    """
    amt = F.col("loan_original_amount")
    g = segment_profile(loans, ["loan_status"], {
        "unique_borrowers": F.count_distinct("member_key"),
        "avg_loan_amount": K.avg_x(amt),
        "min_loan_amount": F.min(amt),
        "max_loan_amount": F.max(amt),
        "avg_borrower_apr": K.avg_x(F.col("borrower_apr").cast(D(10, 4))),
        "avg_monthly_payment": K.avg_x("monthly_loan_payment"),
    }, count_name="total_loans")
    total = F.sum("total_loans").over(Window.partitionBy())
    return (g.withColumn("portfolio_share_pct",
                         K.pct("total_loans", total))
            .transform(sorted_by(F.desc("total_loans"))))


def s05_default_factors(loans: DataFrame) -> DataFrame:
    """Per status: average APR, DTI, income, open credit lines; count."""
    return segment_profile(loans, ["loan_status"], {
        "avg_borrower_apr": K.avg_x("borrower_apr"),
        "avg_dti": K.avg_x("debt_to_income_ratio"),
        "avg_monthly_income": K.avg_x("stated_monthly_income"),
        "avg_open_credit_lines": K.avg_x("open_credit_lines"),
    }, count_name="total_loans")


def s06_yearly_trend(loans: DataFrame) -> DataFrame:
    """Per origination year of the safely parsed raw date (unparseable -> NULL year)."""
    raw = F.col("loan_origination_raw")
    df = (loans.filter(raw.isNotNull())
          .withColumn("origination_year", F.year(K.safe_timestamp(raw))))
    amt = F.col("loan_original_amount")
    g = segment_profile(df, ["origination_year"], {
        "avg_loan_amount": K.avg_x(amt),
        "avg_interest_rate": K.avg_x(F.col("borrower_rate").cast(D(10, 4))),
        "default_rate_pct": K.bad_pct(),
        "avg_investors_per_loan": K.avg_x("investors"),
        "total_loan_volume": F.sum(amt).cast(D(38, 2)),
        "current_loans_pct": K.pct(K.count_if(K.is_status(B.STATUS_CURRENT)), K.n_rows()),
    }, count_name="loans_originated")
    return (g.select(F.col("origination_year").cast("int").alias("origination_year"),
                     "loans_originated", "avg_loan_amount", "avg_interest_rate",
                     "default_rate_pct", "avg_investors_per_loan", "total_loan_volume",
                     "current_loans_pct")
            .transform(sorted_by(F.desc("origination_year"))))


# --- oracles ------------------------------------------------------------------

SQL = {
    "s01_post2009_snapshot": S.over_loans("""
SELECT loan_origination_date, loan_original_amount, lp_customer_payments, estimated_return, estimated_loss
FROM loan WHERE loan_origination_date >= DATE '2009-12-31'"""),

    "s01_snapshot_in_range": S.over_loans("""
SELECT loan_origination_date, loan_original_amount, lp_customer_payments, estimated_return, estimated_loss
FROM loan WHERE loan_origination_date > DATE '1998-01-04'"""),

    "s02_net_return": S.over_loans("""
SELECT loan_number, loan_original_amount, lender_yield, lp_customer_payments, lp_gross_principal_loss,
       CAST(lp_customer_payments - lp_gross_principal_loss AS DECIMAL(16,2)) AS net_return
FROM loan WHERE loan_status IN ('Completed','Chargedoff','Defaulted')"""),

    "s03_time_to_default": S.over_loans("""
SELECT loan_number, loan_origination_date, closed_date,
       CAST(date_diff('day', loan_origination_date, closed_date) AS INTEGER) AS days_to_default,
       loan_status
FROM loan WHERE loan_status IN ('Defaulted','Chargedoff') AND closed_date IS NOT NULL"""),

    "s04_status_summary": S.over_loans(f"""
SELECT loan_status,
       {S.N} AS total_loans,
       CAST(COUNT(DISTINCT member_key) AS BIGINT) AS unique_borrowers,
       {S.avg_x('loan_original_amount')} AS avg_loan_amount,
       MIN(loan_original_amount) AS min_loan_amount,
       MAX(loan_original_amount) AS max_loan_amount,
       {S.avg_x('CAST(borrower_apr AS DECIMAL(10,4))')} AS avg_borrower_apr,
       {S.avg_x('monthly_loan_payment')} AS avg_monthly_payment,
       {S.pct('COUNT(*)', '(SELECT COUNT(*) FROM loan)')} AS portfolio_share_pct
FROM loan GROUP BY loan_status"""),

    "s05_default_factors": S.over_loans(f"""
SELECT loan_status,
       {S.avg_x('borrower_apr')} AS avg_borrower_apr,
       {S.avg_x('debt_to_income_ratio')} AS avg_dti,
       {S.avg_x('stated_monthly_income')} AS avg_monthly_income,
       {S.avg_x('open_credit_lines')} AS avg_open_credit_lines,
       {S.N} AS total_loans
FROM loan GROUP BY loan_status"""),

    "s06_yearly_trend": S.over_loans(f"""
SELECT CAST(year(TRY_CAST(loan_origination_raw AS TIMESTAMP)) AS INTEGER) AS origination_year,
       {S.N} AS loans_originated,
       {S.avg_x('loan_original_amount')} AS avg_loan_amount,
       {S.avg_x('CAST(borrower_rate AS DECIMAL(10,4))')} AS avg_interest_rate,
       {S.BAD_PCT} AS default_rate_pct,
       {S.avg_x('investors')} AS avg_investors_per_loan,
       CAST(SUM(loan_original_amount) AS DECIMAL(38,2)) AS total_loan_volume,
       {S.pct(f"COUNT(*) FILTER ({S.CURRENT})", 'COUNT(*)')} AS current_loans_pct
FROM loan WHERE loan_origination_raw IS NOT NULL
GROUP BY year(TRY_CAST(loan_origination_raw AS TIMESTAMP))"""),
}

FUNCS = {
    "s01_post2009_snapshot": s01_post2009_snapshot,
    "s01_snapshot_in_range": s01_snapshot_in_range,
    "s02_net_return": s02_net_return,
    "s03_time_to_default": s03_time_to_default,
    "s04_status_summary": s04_status_summary,
    "s05_default_factors": s05_default_factors,
    "s06_yearly_trend": s06_yearly_trend,
}
