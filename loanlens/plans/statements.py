"""DuckDB statements of the segmentation, window, scenario and score analyses.

Each states the result in its own way: labels come from literal tables of
bounds, counts from ``FILTER``, percentages from integer quotients and
remainders (``sqlkit.half_up``). Nothing is taken from the Spark code, so a
changed cut, label or rounding there turns the key red.
"""

from __future__ import annotations

from loanlens.plans.sqlkit import (
    BAD, BAD_PCT, COMPLETED, CURRENT, PAST_DUE, avg_x, currency, half_up, mean, month_boundaries, over_loans, pct, quantize6, total)

DEFAULTS = f"COUNT(*) FILTER ({BAD})"
SCORE_SUM = "credit_score_range_lower + credit_score_range_upper"
MEAN_SCORE = half_up(f"SUM({SCORE_SUM})", f"COUNT({SCORE_SUM}) * 2", 0)
RATE_PCT = mean("borrower_rate", 4, 2, 100)
MEAN_AMOUNT = mean("loan_original_amount", 2, 0)
MEAN_INCOME = mean("stated_monthly_income", 2, 0)
MEAN_DTI = mean("debt_to_income_ratio", 4, 3)
VOLUME = "CAST(SUM(loan_original_amount) AS DECIMAL(38,2))"
RAW_TIME = "TRY_CAST(loan_origination_raw AS TIMESTAMP)"


def band(name: str, x: str, bounds: str, low_open: bool = True) -> str:
    """Join of a literal table (lo, hi, label): lo < x <= hi, or lo <= x < hi."""
    a, b = (">", "<=") if low_open else (">=", "<")
    return (f"LEFT JOIN (VALUES {bounds}) AS {name}(lo, hi, label) ON ({name}.lo IS NULL OR {x} {a} {name}.lo) "
            f"AND ({name}.hi IS NULL OR {x} {b} {name}.hi) AND {x} IS NOT NULL")


def ratio_of_means(x: str, y: str, d: int, times: int = 100, per: int = 1) -> str:
    """Rounded mean(x) * times / (mean(y) * per), both with two places."""
    return half_up(f"{total(x)} * COUNT({y}) * {times}", f"{total(y)} * COUNT({x}) * {per}", d)


def difference_of_means(x: str, y: str, d: int, times: int) -> str:
    """Rounded (mean(x) - mean(y)) * times, both with four places."""
    return half_up(f"({total(x, 4)} * COUNT({y}) - {total(y, 4)} * COUNT({x})) * {times}", f"COUNT({x})::HUGEINT * COUNT({y}) * 10000", d)


SQL = {
    "s10_dti_segment": over_loans(f"""
SELECT COALESCE(b.label, 'High DTI (> 35%)') AS dti_segment, COUNT(*) AS total_loans,
       {avg_x('borrower_apr')} AS avg_borrower_apr, CAST({DEFAULTS} AS DOUBLE) / COUNT(*) AS default_rate
FROM loan {band('b', 'debt_to_income_ratio', "(NULL, 0.20, 'Low DTI  (< 20%)'), (0.20, 0.35, 'Mid DTI  (20–35%)')", False)}
WHERE debt_to_income_ratio IS NOT NULL GROUP BY 1"""),

    "s13_investor_concentration": over_loans(f"""
SELECT COALESCE(b.label, '500+ Investors') AS investor_tier, COUNT(*) AS loan_count,
       {pct('COUNT(*)', '(SELECT COUNT(*) FROM loan)')} AS portfolio_share_pct,
       {avg_x('loan_original_amount')} AS avg_loan_amount, {avg_x('percent_funded')} AS avg_percent_funded,
       {BAD_PCT} AS default_rate_pct, {avg_x('borrower_rate')} AS avg_borrower_rate, {VOLUME} AS total_loan_volume
FROM loan {band('b', 'investors', "(0, 1, '1 Investor'), (1, 10, '2–10 Investors'), (10, 50, '11–50 Investors'), "
                "(50, 100, '51–100 Investors'), (100, 500, '101–500 Investors')")}
WHERE investors IS NOT NULL GROUP BY 1"""),

    "s14_loss_recovery": over_loans(f"""
SELECT COALESCE(o.outcome, 'Other') AS loan_outcome, COUNT(*) AS loan_count,
       {VOLUME} AS total_original_amount,
       {avg_x('lp_gross_principal_loss')} AS avg_gross_principal_loss, {avg_x('lp_net_principal_loss')} AS avg_net_principal_loss,
       CAST(SUM(lp_gross_principal_loss) AS DECIMAL(38,2)) AS total_gross_loss,
       CAST(SUM(lp_net_principal_loss) AS DECIMAL(38,2)) AS total_net_loss,
       {avg_x('lp_non_principal_recovery_payments')} AS avg_recoveries,
       {ratio_of_means('lp_non_principal_recovery_payments', 'lp_gross_principal_loss', 2)} AS recovery_rate_pct,
       {avg_x('investors')} AS avg_investors
FROM loan LEFT JOIN (VALUES ('Completed', 'Completed'), ('Current', 'Current'), ('Defaulted', 'Defaulted / Charged-Off'),
                            ('Chargedoff', 'Defaulted / Charged-Off')) AS o(status, outcome) ON o.status = loan_status
WHERE lp_gross_principal_loss IS NOT NULL GROUP BY 1"""),

    "s18_dti_delinquency": over_loans(f"""
SELECT COALESCE(b.label, '60%+   (Critical)') AS dti_range, COUNT(*) AS borrower_count,
       {avg_x('loan_current_days_delinquent')} AS avg_days_delinquent,
       {pct("COUNT(*) FILTER (loan_status <> 'Current')", 'COUNT(*)')} AS delinquency_rate_pct
FROM loan {band('b', 'debt_to_income_ratio',
                "(NULL, 0.20, '0–20%  (Low)'), (0.20, 0.40, '21–40% (Mid)'), (0.40, 0.60, '41–60% (High)')")}
WHERE debt_to_income_ratio IS NOT NULL GROUP BY 1"""),

    "s20_term_compare": over_loans(f"""
SELECT term, COUNT(*) AS loan_count, {VOLUME} AS total_volume, {MEAN_AMOUNT} AS avg_loan_amount,
       {RATE_PCT} AS avg_interest_rate, {DEFAULTS} AS default_count, {BAD_PCT} AS default_rate_pct, {MEAN_DTI} AS avg_dti,
       {MEAN_INCOME} AS avg_monthly_income, {MEAN_SCORE} AS avg_credit_score, {mean('monthly_loan_payment', 2, 2)} AS avg_monthly_payment,
       {ratio_of_means('loan_original_amount', 'monthly_loan_payment', 1, 1)} AS months_to_payoff,
       {ratio_of_means('monthly_loan_payment', 'stated_monthly_income', 2)} AS payment_to_income_pct, any_value(term_label) AS term_label
FROM loan JOIN (VALUES (36, 'Medium Term'), (60, 'Long Term')) AS t(term, term_label) USING (term) GROUP BY term"""),

    "s21_yield_matrix": over_loans(f"""
SELECT risk_rating, COUNT(listing_key) AS total_loans, {mean('borrower_apr', 4, 2, 100)} AS avg_borrower_apr_pct,
       {mean('lender_yield', 4, 2, 100)} AS avg_lender_yield_pct, {mean('estimated_loss', 4, 2, 100)} AS avg_estimated_loss_pct,
       {difference_of_means('lender_yield', 'estimated_loss', 2, 100)} AS net_estimated_return_pct,
       {currency(VOLUME)} AS total_volume_usd
FROM loan WHERE risk_rating IS NOT NULL AND term = 36 GROUP BY risk_rating"""),

    "s23_repeat_borrower_history": over_loans(f"""
SELECT total_loans, COUNT(*) AS borrower_count, {avg_x('total_borrowed')} AS avg_total_borrowed, {avg_x('rate')} AS avg_borrow_rate,
       {pct('SUM(failed)', 'SUM(total_loans)')} AS overall_default_rate_pct, {avg_x('score')} AS avg_credit_score, {avg_x('dti')} AS avg_dti
FROM (SELECT COUNT(*) AS total_loans, SUM(loan_original_amount) AS total_borrowed, {quantize6(avg_x('borrower_rate'))} AS rate,
             {DEFAULTS} AS failed, {quantize6(avg_x('credit_score_range_lower'))} AS score,
             {quantize6(avg_x('CAST(debt_to_income_ratio AS DECIMAL(10,2))'))} AS dti
      FROM loan WHERE member_key IS NOT NULL GROUP BY member_key)
WHERE total_loans <= 10 GROUP BY total_loans"""),

    "s24_monthly_seasonality": over_loans(f"""
SELECT CAST(y AS INTEGER) AS origination_year, CAST(m AS INTEGER) AS origination_month, quarter, loans_originated, total_volume,
       avg_borrower_rate, default_count, {pct('default_count', 'loans_originated')} AS monthly_default_rate_pct, completed_count,
       current_count, CAST(in_year // months_in_year AS BIGINT) AS yearly_avg_monthly_loans,
       CAST(in_quarter // months_in_quarter AS BIGINT) AS quarterly_avg_defaults
FROM (SELECT *, SUM(loans_originated) OVER a AS in_year, COUNT(*) OVER a AS months_in_year,
             SUM(default_count) OVER q AS in_quarter, COUNT(*) OVER q AS months_in_quarter
      FROM (SELECT year({RAW_TIME}) AS y, month({RAW_TIME}) AS m, 'Q' || COALESCE(quarter({RAW_TIME}), 4) AS quarter,
                   COUNT(*) AS loans_originated, {VOLUME} AS total_volume, {avg_x('borrower_rate')} AS avg_borrower_rate,
                   {DEFAULTS} AS default_count, COUNT(*) FILTER ({COMPLETED}) AS completed_count,
                   COUNT(*) FILTER ({CURRENT}) AS current_count
            FROM loan WHERE loan_origination_raw IS NOT NULL GROUP BY ALL)
      WINDOW a AS (PARTITION BY y), q AS (PARTITION BY quarter))"""),

    "s25_investor_returns": over_loans(f"""
SELECT COALESCE(b.label, '<50 Investors') AS investor_tier, COUNT(*) AS loan_count, {avg_x('loan_original_amount')} AS avg_loan_size,
       CAST(TRUNC(SUM(months)::DECIMAL(38,0) / COUNT(months)) AS BIGINT) AS avg_months_active,
       {avg_x('borrower_rate')} AS avg_borrower_rate, {avg_x('lender_yield')} AS avg_lender_yield,
       {ratio_of_means('lp_customer_payments', 'loan_original_amount', 2)} AS avg_total_return_pct,
       {ratio_of_means('lp_interest_and_fees', 'loan_original_amount', 2)} AS avg_interest_return_pct,
       {ratio_of_means('lp_net_principal_loss', 'loan_original_amount', 2)} AS avg_loss_rate_pct, {BAD_PCT} AS default_rate_pct,
       CAST(CASE WHEN bool_and(percent_funded IS NOT NULL AND percent_funded <= 1) THEN 100 ELSE 0 END AS DECIMAL(18,2)) AS fully_funded_pct
FROM (SELECT *, {month_boundaries(RAW_TIME, "COALESCE(CAST(closed_date AS TIMESTAMP), TIMESTAMP '2002-01-01')")} AS months FROM loan)
{band('b', 'investors', "(500, NULL, '500+ Investors'), (200, 500, '200–499 Investors'), (100, 200, '100–199 Investors'), "
      "(50, 100, '50–99 Investors')", False)}
WHERE loan_original_amount IS NOT NULL AND investors IS NOT NULL AND lender_yield IS NOT NULL GROUP BY 1"""),

    "s26_geo_concentration": over_loans(f"""
SELECT state_rank, borrower_state, state_loans, state_loan_volume, volume_share_pct,
       CAST(SUM(volume_share_pct) OVER (ORDER BY state_rank ROWS UNBOUNDED PRECEDING) AS DECIMAL(18,2)) AS cumulative_volume_pct,
       avg_state_rate, state_default_rate_pct,
       COALESCE((SELECT label FROM (VALUES (1, 10, 'Top 10 States'), (11, 25, 'Top 25 States')) t(lo, hi, label)
                 WHERE state_rank BETWEEN lo AND hi), 'Remainder') AS concentration_tier
FROM (SELECT borrower_state, state_loans, state_loan_volume, avg_state_rate, state_default_rate_pct,
             {half_up('cents * 100', 'whole')} AS volume_share_pct,
             CAST(ROW_NUMBER() OVER (ORDER BY state_loans DESC, borrower_state) AS INTEGER) AS state_rank
      FROM (SELECT borrower_state, COUNT(*) AS state_loans, {VOLUME} AS state_loan_volume, {total('loan_original_amount')} AS cents,
                   {avg_x('borrower_rate')} AS avg_state_rate, {BAD_PCT} AS state_default_rate_pct
            FROM loan WHERE borrower_state IS NOT NULL GROUP BY borrower_state),
           (SELECT {total('loan_original_amount')} AS whole FROM loan))"""),

    "s27_credit_utilization": over_loans(f"""
SELECT COALESCE(b.label, '91–100%+') AS utilization_bucket, COUNT(*) AS borrower_count, {RATE_PCT} AS avg_interest_rate,
       {MEAN_SCORE} AS avg_credit_score, {DEFAULTS} AS default_count, {BAD_PCT} AS default_rate_pct, {MEAN_AMOUNT} AS avg_loan_amount,
       {mean('revolving_credit_balance', 2, 0)} AS avg_revolving_balance, {mean('available_bankcard_credit', 2, 0)} AS avg_available_credit,
       {half_up(f"{total('revolving_credit_balance')} * COUNT(available_bankcard_credit) * 100",
                f"({total('revolving_credit_balance')} * COUNT(available_bankcard_credit) + "
                f"{total('available_bankcard_credit')} * COUNT(revolving_credit_balance))")} AS calculated_utilization_pct
FROM loan {band('b', 'bankcard_utilization', "(NULL, 0.10, '0–10%'), (0.10, 0.30, '11–30%'), (0.30, 0.50, '31–50%'), "
                "(0.50, 0.70, '51–70%'), (0.70, 0.90, '71–90%')")}
WHERE bankcard_utilization >= 0 AND bankcard_utilization <= 1 GROUP BY 1"""),

    "s28_delinquency_history": over_loans(f"""
SELECT current_delinq_bucket, historical_delinq_bucket, loan_count, avg_interest_rate, default_count, default_rate_pct,
       avg_credit_score, avg_loan_amount, {pct('loan_count', 'SUM(loan_count) OVER ()')} AS portfolio_share_pct
FROM (SELECT COALESCE(n.label, '6+ Delinquencies') AS current_delinq_bucket,
             COALESCE(p.label, '11+ Past Delinquencies') AS historical_delinq_bucket, COUNT(*) AS loan_count,
             {RATE_PCT} AS avg_interest_rate, {DEFAULTS} AS default_count, {BAD_PCT} AS default_rate_pct,
             {MEAN_SCORE} AS avg_credit_score, {MEAN_AMOUNT} AS avg_loan_amount
      FROM loan {band('n', 'current_delinquencies',
                      "(-1, 0, '0 Delinquencies'), (0, 2, '1–2 Delinquencies'), (2, 5, '3–5 Delinquencies')")}
      {band('p', 'delinquencies_last_7_years',
            "(-1, 0, '0 Past Delinquencies'), (0, 5, '1–5 Past Delinquencies'), (5, 10, '6–10 Past Delinquencies')")}
      WHERE current_delinquencies IS NOT NULL AND delinquencies_last_7_years IS NOT NULL
      GROUP BY 1, 2 HAVING COUNT(*) >= 5)"""),

    "s29_investor_performance": over_loans(f"""
SELECT COALESCE(b.label, '200+ Investors') AS investor_category, COUNT(*) AS loan_count,
       {half_up('SUM(investors)', 'COUNT(investors)', 0)} AS avg_investors_per_loan, {MEAN_AMOUNT} AS avg_loan_amount,
       {RATE_PCT} AS avg_interest_rate, {mean('lender_yield', 4, 2, 100)} AS avg_lender_yield, {DEFAULTS} AS default_count,
       {BAD_PCT} AS actual_default_rate_pct, {mean('estimated_effective_yield', 4, 2, 100)} AS avg_estimated_yield,
       {mean('estimated_loss', 4, 2, 100)} AS avg_estimated_loss, {mean('estimated_return', 4, 2, 100)} AS avg_estimated_return,
       {difference_of_means('lender_yield', 'estimated_loss', 2, 100)} AS net_expected_return
FROM loan {band('b', 'investors', "(0, 10, '1–10 Investors'), (10, 50, '11–50 Investors'), (50, 100, '51–100 Investors'), "
                "(100, 200, '101–200 Investors')")}
WHERE investors > 0 GROUP BY 1"""),

    "s30_stress_test": over_loans(f"""
SELECT scenario, n AS total_loans, CAST(volume AS DECIMAL(38,2)) AS total_volume, rate AS avg_rate,
       CAST(ROUND(bad_rate * coalesce(factor, 100) * 0.01, 2) AS DECIMAL(18,2)) AS current_default_rate,
       CASE WHEN factor IS NULL THEN CAST(lost * 0.01 AS DECIMAL(38,2))
            ELSE CAST({half_up('lost * factor', '10000', 0)} AS DECIMAL(38,2)) END AS actual_losses,
       CAST(paid AS DECIMAL(38,3)) AS adjusted_monthly_payments,
       {half_up('lost * coalesce(factor, 100)', 'CAST(volume * 100 AS HUGEINT)')} AS loss_rate_pct
FROM (VALUES ('Baseline (Actual)', NULL), ('Mild Stress (+5% Defaults)', 105), ('Moderate Stress (+15% Defaults)', 115),
             ('Severe Stress (+25% Defaults)', 125)) AS s(scenario, factor),
     (SELECT COUNT(*) AS n, SUM(loan_original_amount) AS volume, {avg_x('borrower_rate')} AS rate, {BAD_PCT} AS bad_rate,
             CAST(COALESCE(SUM(loan_original_amount) FILTER ({BAD}), 0) * 100 AS HUGEINT) AS lost,
             SUM(monthly_loan_payment * CASE WHEN {BAD} THEN 0.0 WHEN {PAST_DUE} THEN 0.5 ELSE 1.0 END) AS paid
      FROM loan)"""),

    "s31_geo_risk": over_loans(f"""
SELECT borrower_state, total_loans, total_volume, avg_interest_rate, default_count, default_rate_pct, avg_credit_score, avg_dti,
       avg_monthly_income, default_rate_rank, volume_rank, interest_rate_rank,
       CASE WHEN default_rate_rank > 15 THEN 'Low Risk' WHEN default_rate_rank > 5 THEN 'Medium Risk' ELSE 'High Risk' END AS risk_category
FROM (SELECT *, CAST(RANK() OVER (ORDER BY default_count / total_loans DESC) AS INTEGER) AS default_rate_rank,
             CAST(RANK() OVER (ORDER BY total_volume DESC) AS INTEGER) AS volume_rank,
             CAST(RANK() OVER (ORDER BY rate DESC) AS INTEGER) AS interest_rate_rank
      FROM (SELECT borrower_state, COUNT(*) AS total_loans, {VOLUME} AS total_volume, {RATE_PCT} AS avg_interest_rate,
                   {avg_x('borrower_rate * 100')} AS rate, {DEFAULTS} AS default_count, {BAD_PCT} AS default_rate_pct,
                   {MEAN_SCORE} AS avg_credit_score, {MEAN_DTI} AS avg_dti, {MEAN_INCOME} AS avg_monthly_income
            FROM loan WHERE borrower_state <> '' GROUP BY borrower_state HAVING COUNT(*) >= 5))"""),

    "s32_borrower_characteristics": over_loans(f"""
SELECT income_category, is_borrower_homeowner, employment_status, borrower_count, avg_credit_score, avg_dti, avg_loan_size,
       default_rate_pct, avg_interest_rate, avg_monthly_income, {pct('borrower_count', 'SUM(borrower_count) OVER ()')} AS portfolio_share_pct
FROM (SELECT COALESCE(i.label, 'Not Displayed') AS income_category, is_borrower_homeowner, employment_status, COUNT(*) AS borrower_count,
             {MEAN_SCORE} AS avg_credit_score, {MEAN_DTI} AS avg_dti, {MEAN_AMOUNT} AS avg_loan_size, {BAD_PCT} AS default_rate_pct,
             {RATE_PCT} AS avg_interest_rate, {MEAN_INCOME} AS avg_monthly_income
      FROM loan LEFT JOIN (VALUES ('Not employed', 'No Income'), ('$0', 'No Income'), ('$1-24,999', 'Low Income'),
                                  ('$25,000-49,999', 'Lower Middle'), ('$50,000-74,999', 'Middle Income'),
                                  ('$75,000-99,999', 'Upper Middle'), ('$100,000+', 'High Income')) AS i(name, label) ON i.name = income_range
      WHERE income_range <> 'Not displayed' GROUP BY ALL)"""),

    "s33_payment_to_income": over_loans(f"""
SELECT pti_bucket, loan_count, avg_pti_pct, avg_interest_rate, avg_loan_amount, avg_monthly_income, default_count, default_rate_pct,
       avg_term_months, {pct('loan_count', 'SUM(loan_count) OVER ()')} AS portfolio_share_pct
FROM (SELECT CASE WHEN paid > 45 * income THEN 'Very High (>45%)' WHEN paid > 35 * income THEN 'High (36–45%)'
                  WHEN paid > 25 * income THEN 'Moderate (26–35%)' WHEN paid > 15 * income THEN 'Low (16–25%)'
                  ELSE 'Very Low (≤15%)' END AS pti_bucket,
             COUNT(*) AS loan_count, {mean('share', 6, 1)} AS avg_pti_pct, {RATE_PCT} AS avg_interest_rate, {MEAN_AMOUNT} AS avg_loan_amount,
             {MEAN_INCOME} AS avg_monthly_income, {DEFAULTS} AS default_count, {BAD_PCT} AS default_rate_pct,
             {half_up('SUM(term)', 'COUNT(term)', 0)} AS avg_term_months
      FROM (SELECT *, CAST(monthly_loan_payment * 10000 AS HUGEINT) AS paid, CAST(stated_monthly_income * 100 AS HUGEINT) AS income,
                   {quantize6('CAST(monthly_loan_payment * 100 AS DOUBLE) / CAST(stated_monthly_income AS DOUBLE)')} AS share
            FROM loan WHERE monthly_loan_payment > 0 AND stated_monthly_income > 0)
      GROUP BY 1)"""),

    "s34_occupation_risk": over_loans(f"""
SELECT occupation, employment_status, COUNT(*) AS occupation_loans, COUNT(DISTINCT member_key) AS unique_workers,
       {avg_x('stated_monthly_income')} AS avg_monthly_income, {MEAN_AMOUNT} AS avg_loan_amount,
       {half_up('SUM(employment_status_duration)', 'COUNT(employment_status_duration)', 0)} AS avg_employment_months,
       {mean('borrower_rate', 4, 4)} AS avg_borrower_rate, {DEFAULTS} AS default_count, {BAD_PCT} AS default_rate_pct,
       COUNT(*) FILTER ({COMPLETED}) AS completed_count, {mean('CAST(debt_to_income_ratio AS DECIMAL(10,2))', 2, 3)} AS avg_dti,
       {half_up('SUM(credit_score_range_lower)', 'COUNT(credit_score_range_lower)', 0)} AS avg_credit_score,
       {ratio_of_means('loan_original_amount', 'stated_monthly_income', 2, 100, 12)} AS loan_to_annual_income_ratio,
       CAST(ROW_NUMBER() OVER (ORDER BY {DEFAULTS} DESC, occupation, employment_status) AS INTEGER) AS risk_rank
FROM loan WHERE occupation <> 'Other' AND employment_status IS NOT NULL GROUP BY occupation, employment_status HAVING COUNT(*) >= 100"""),

    "s35_default_propensity": over_loans(f"""
SELECT COALESCE(s.label, 'Below 640 (Deep Sub)') AS credit_tier, COALESCE(d.label, 'High DTI') AS dti_tier,
       CASE WHEN current_delinquencies = 0 THEN 'Clean' ELSE 'Delinquent' END AS delinquency_status, term, COUNT(*) AS segment_loans,
       {DEFAULTS} AS segment_defaults, {BAD_PCT} AS default_probability_pct, COUNT(*) FILTER ({COMPLETED}) AS segment_completed,
       COUNT(*) FILTER ({CURRENT}) AS segment_current,
       {pct(f"COUNT(*) FILTER ({COMPLETED} OR {CURRENT})", 'COUNT(*)')} AS performance_rate_pct,
       {half_up(f"{DEFAULTS} * 10000 - COUNT(*) * any_value(whole)", 'COUNT(*) * 100')} AS variance_from_portfolio_avg
FROM loan {band('s', 'credit_score_range_lower',
                "(720, NULL, '720+ (Prime)'), (680, 720, '680–719 (Near-Prime)'), (640, 680, '640–679 (Subprime)')", False)}
{band('d', 'debt_to_income_ratio', "(NULL, 0.30, 'Low DTI'), (0.30, 0.50, 'Mid DTI')", False)},
     (SELECT CAST({BAD_PCT} * 100 AS HUGEINT) AS whole FROM loan)
WHERE credit_score_range_lower IS NOT NULL AND debt_to_income_ratio IS NOT NULL AND current_delinquencies IS NOT NULL
GROUP BY 1, 2, 3, 4"""),

    "s36_borrower_progression": over_loans(f"""
SELECT CASE WHEN bad_rate > 0.50 OR (bad_rate > 0 AND bad_rate < 0.01) OR (bad_rate > 0.25 AND bad_rate < 0.26) THEN 'High-Risk'
            WHEN bad_rate >= 0.26 THEN 'Medium-Risk' WHEN bad_rate >= 0.01 THEN 'Low-Risk'
            WHEN good = held THEN 'Perfect-Performing' WHEN open_or_late > 0 THEN 'Currently-Performing' ELSE 'High-Risk' END AS performance_profile,
       COUNT(*) AS borrower_count, CAST(SUM(held) // COUNT(*) AS BIGINT) AS avg_loans_per_borrower, {avg_x('bad_rate')} AS avg_default_rate,
       {avg_x('least')} AS avg_lowest_credit_score, {avg_x('most')} AS avg_highest_credit_score, {avg_x('rate')} AS avg_borrow_rate,
       CAST(SUM(held) AS BIGINT) AS total_loans_in_profile, {avg_x('size')} AS avg_loan_size
FROM (SELECT member_key, COUNT(DISTINCT loan_key) AS held, COUNT(*) FILTER ({COMPLETED} OR {CURRENT}) AS good,
             COUNT(*) FILTER ({CURRENT} OR {PAST_DUE}) AS open_or_late, {BAD_PCT} AS bad_rate,
             MIN(credit_score_range_lower) AS least, MAX(credit_score_range_lower) AS most,
             {quantize6(avg_x('borrower_rate'))} AS rate, {quantize6(avg_x('loan_original_amount'))} AS size
      FROM loan WHERE member_key IS NOT NULL GROUP BY member_key)
GROUP BY 1"""),

    "s37_composite_score": over_loans(f"""
SELECT risk_category, COUNT(*) AS loan_count, CAST(SUM(points) // COUNT(*) AS BIGINT) AS avg_risk_score,
       {avg_x('CAST(points * 5 AS DECIMAL(18,2))')} AS avg_risk_score_pct, {BAD_PCT} AS actual_default_rate_pct,
       {avg_x('borrower_rate')} AS avg_rate_charged, {avg_x('loan_original_amount')} AS avg_loan_amount,
       COUNT(DISTINCT member_key) AS unique_borrowers
FROM (SELECT *, CASE WHEN points > 13 THEN 'Very High Risk' WHEN points > 8 THEN 'High Risk' WHEN points > 3 THEN 'Medium Risk'
                     ELSE 'Low Risk' END AS risk_category
      FROM (SELECT loan.*, COALESCE(cs.label, 4) + COALESCE(dt.label, 4) + COALESCE(dl.label, 3) + COALESCE(pr.points, 3)
                           + COALESCE(em.points, 1) AS points
            FROM loan {band('cs', 'credit_score_range_lower', "(760, NULL, 0), (720, 760, 1), (680, 720, 2), (640, 680, 3)", False)}
            {band('dt', 'debt_to_income_ratio', "(NULL, 0.20, 0), (0.20, 0.35, 1), (0.35, 0.50, 2), (0.50, 0.70, 3)", False)}
            {band('dl', 'current_delinquencies', "(-1, 0, 0), (0, 2, 1), (2, 5, 2)")}
            LEFT JOIN (VALUES (0, 0), (1, 2)) AS pr(records, points) ON pr.records = public_records_last_10_years
            LEFT JOIN (VALUES ('Employed', 0), ('Self-employed', 1), ('Not employed', 3)) AS em(status, points) ON em.status = employment_status
            WHERE credit_score_range_lower IS NOT NULL AND debt_to_income_ratio IS NOT NULL))
GROUP BY risk_category"""),

    "s38_scorecard": over_loans(f"""
SELECT risk_category, credit_score_category, dti_category, employment_stability, income_category, housing_status, loan_count,
       avg_interest_rate, avg_loan_amount, default_count, default_rate_pct, {pct('loan_count', 'SUM(loan_count) OVER ()')} AS portfolio_share_pct,
       CAST(RANK() OVER (ORDER BY default_count / loan_count DESC) AS INTEGER) AS risk_rank
FROM (SELECT CASE WHEN twice < 1280 OR debt_to_income_ratio > 0.50 THEN 'High Risk'
                  WHEN twice >= 1440 AND debt_to_income_ratio <= 0.30 AND employment_status_duration >= 24
                       AND income_range IN ('$50,000-74,999', '$75,000-99,999', '$100,000+') THEN 'Low Risk' ELSE 'Medium Risk' END AS risk_category,
             COALESCE(cs.label, 'Poor (<640)') AS credit_score_category, COALESCE(dt.label, 'High DTI (>40%)') AS dti_category,
             COALESCE(em.label, 'Limited (<1 yr)') AS employment_stability, COALESCE(ic.label, 'No/Minimal Income') AS income_category,
             CASE is_borrower_homeowner WHEN 'True' THEN 'Homeowner' ELSE 'Renter' END AS housing_status, COUNT(*) AS loan_count,
             {RATE_PCT} AS avg_interest_rate, {MEAN_AMOUNT} AS avg_loan_amount, {DEFAULTS} AS default_count, {BAD_PCT} AS default_rate_pct
      FROM (SELECT *, {SCORE_SUM} AS twice FROM loan)
      {band('cs', 'twice', "(1440, NULL, 'Excellent (720+)'), (1360, 1440, 'Good (680–719)'), (1280, 1360, 'Fair (640–679)')", False)}
      {band('dt', 'debt_to_income_ratio', "(NULL, 0.20, 'Low DTI (≤20%)'), (0.20, 0.40, 'Medium DTI (21–40%)')")}
      {band('em', 'employment_status_duration', "(60, NULL, 'Very Stable (5+ yrs)'), (24, 60, 'Stable (2–5 yrs)'), "
            "(12, 24, 'Some Stability (1–2 yrs)')", False)}
      LEFT JOIN (VALUES ('$100,000+', 'High Income'), ('$75,000-99,999', 'Middle Income'), ('$50,000-74,999', 'Middle Income'),
                        ('$25,000-49,999', 'Lower Middle'), ('$1-24,999', 'Low Income')) AS ic(name, label) ON ic.name = income_range
      WHERE credit_score_range_lower IS NOT NULL AND debt_to_income_ratio IS NOT NULL AND employment_status_duration IS NOT NULL
        AND income_range <> 'Not displayed'
      GROUP BY ALL HAVING COUNT(*) >= 5)"""),
}
