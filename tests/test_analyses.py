"""Semantics of individual analyses on inline rows and invariants on sf0.01."""
from decimal import Decimal

from pyspark.sql import functions as F

from loanlens.plans import tier1, tier2, tier3, tier4

from helpers import make_loans


def _borrower(member, n, bad=0, status="Completed"):
    rows = []
    for i in range(n):
        rows.append({"member_key": member, "loan_key": f"{member}-{i}",
                     "loan_status": "Defaulted" if i < bad else status,
                     "borrower_rate": "0.1000", "loan_original_amount": "100.00",
                     "credit_score_range_lower": 700})
    return rows


def test_s36_percentage_compared_with_fraction_bands(spark):
    # one bad loan among 199 -> 0.50 (Medium), 393 -> 0.25 (Low), 198 -> 0.51 (High)
    rows = _borrower("m199", 199, 1) + _borrower("m393", 393, 1) + _borrower("m198", 198, 1) \
        + _borrower("perfect", 3) + _borrower("current", 2, 0, "Current") \
        + _borrower("other", 2, 0, "Cancelled")
    out = {r["performance_profile"]: r for r in
           tier4.s36_borrower_progression(make_loans(spark, rows)).collect()}
    assert out["Medium-Risk"]["borrower_count"] == 1
    assert out["Low-Risk"]["borrower_count"] == 1
    assert out["Perfect-Performing"]["borrower_count"] == 2      # completed-only and current-only
    assert out["High-Risk"]["borrower_count"] == 2               # 198 loans, and 'Cancelled' only
    assert out["Low-Risk"]["avg_loans_per_borrower"] == 393


def test_s36_counts_distinct_loan_keys(spark):
    rows = _borrower("dup", 2)
    rows.append(dict(rows[0]))          # duplicate loan key: 3 rows, 2 distinct loans
    r = tier4.s36_borrower_progression(make_loans(spark, rows)).first()
    assert r["total_loans_in_profile"] == 2
    # completed (3) + current (0) != distinct loans (2): not 'Perfect'
    assert r["performance_profile"] == "High-Risk"


def test_s25_fully_funded_is_zero_or_hundred(spark):
    rows = [{"investors": 5, "loan_original_amount": "10.00", "lender_yield": "0.1000",
             "percent_funded": pf, "loan_status": "Current"} for pf in ("1.0000", "1.0100")]
    r = tier3.s25_investor_returns(make_loans(spark, rows)).first()
    assert r["fully_funded_pct"] == Decimal("0.00")
    rows[1]["percent_funded"] = "0.9000"
    r = tier3.s25_investor_returns(make_loans(spark, rows)).first()
    assert r["fully_funded_pct"] == Decimal("100.00")


def test_s25_months_active_uses_as_of_for_open_loans(spark):
    rows = [{"investors": 5, "loan_original_amount": "10.00", "lender_yield": "0.1000",
             "loan_origination_raw": "2001-12-31", "closed_date": None, "loan_status": "Current"},
            {"investors": 5, "loan_original_amount": "10.00", "lender_yield": "0.1000",
             "loan_origination_raw": "2001-01-31", "closed_date": "2001-02-01",
             "loan_status": "Completed"}]
    r = tier3.s25_investor_returns(make_loans(spark, rows)).first()
    assert r["avg_months_active"] == 1           # (1 + 1) / 2


def test_s18_null_status_counts_as_not_delinquent(spark):
    rows = [{"debt_to_income_ratio": "0.1000", "loan_status": None,
             "loan_current_days_delinquent": 0},
            {"debt_to_income_ratio": "0.1000", "loan_status": "Chargedoff",
             "loan_current_days_delinquent": 10}]
    r = tier3.s18_dti_delinquency(make_loans(spark, rows)).first()
    assert r["delinquency_rate_pct"] == Decimal("50.00")


def test_s08_zero_amount_bad_loan_leaves_average(spark):
    rows = [{"risk_rating": "A", "loan_status": "Defaulted", "lp_gross_principal_loss": "5.00",
             "loan_original_amount": "0.00", "estimated_loss": "0.0100"},
            {"risk_rating": "A", "loan_status": "Defaulted", "lp_gross_principal_loss": "5.00",
             "loan_original_amount": "10.00", "estimated_loss": "0.0100"},
            {"risk_rating": "A", "loan_status": "Current", "lp_gross_principal_loss": "0.00",
             "loan_original_amount": "10.00", "estimated_loss": "0.0100"}]
    r = tier2.s08_expected_vs_realized_loss(make_loans(spark, rows)).first()
    assert r["avg_realized_loss_ratio"] == 0.25


def test_s30_scenarios(spark):
    rows = [{"loan_status": "Defaulted", "loan_original_amount": "100.00",
             "monthly_loan_payment": "10.00", "borrower_rate": "0.1000"},
            {"loan_status": "Past Due (1-15 days)", "loan_original_amount": "300.00",
             "monthly_loan_payment": "10.00", "borrower_rate": "0.2000"},
            {"loan_status": "Current", "loan_original_amount": "600.00",
             "monthly_loan_payment": "10.00", "borrower_rate": "0.3000"}]
    out = {r["scenario"]: r for r in tier4.s30_stress_test(make_loans(spark, rows)).collect()}
    assert len(out) == 4
    base = out["Baseline (Actual)"]
    assert base["current_default_rate"] == Decimal("33.33")
    assert base["actual_losses"] == Decimal("100.00")
    assert base["adjusted_monthly_payments"] == Decimal("15.000")
    assert base["loss_rate_pct"] == Decimal("10.00")
    mild = out["Mild Stress (+5% Defaults)"]
    assert mild["current_default_rate"] == Decimal("35.00")   # 33.33 * 1.05 = 34.9965
    assert mild["actual_losses"] == Decimal("105.00")
    assert out["Severe Stress (+25% Defaults)"]["loss_rate_pct"] == Decimal("12.50")


def test_s37_score_range_and_pct(spark, loans_mid):
    df = tier4.s37_composite_score(loans_mid)
    rows = df.collect()
    assert [r["risk_category"] for r in rows] == ["Low Risk", "Medium Risk", "High Risk",
                                                  "Very High Risk"]
    for r in rows:
        assert 0 <= r["avg_risk_score"] <= 17
        assert r["avg_risk_score_pct"] <= 85.0


def test_group_counts_sum_to_filtered_rows(spark, loans_mid):
    total = loans_mid.count()
    assert tier1.s04_status_summary(loans_mid).agg(F.sum("total_loans")).first()[0] == total
    n_inv = loans_mid.filter(F.col("investors").isNotNull()).count()
    assert tier2.s13_investor_concentration(loans_mid).agg(F.sum("loan_count")).first()[0] == n_inv


def test_group_shares_sum_to_about_100(spark, loans_mid):
    for fn, col in ((tier4.s28_delinquency_history, "portfolio_share_pct"),
                    (tier4.s32_borrower_characteristics, "portfolio_share_pct"),
                    (tier4.s33_payment_to_income, "portfolio_share_pct"),
                    (tier4.s38_scorecard, "portfolio_share_pct")):
        s = fn(loans_mid).agg(F.sum(col)).first()[0]
        assert abs(s - 100) < 3, (fn.__name__, s)


def test_s26_cumulative_equals_sum_of_shares(spark, loans_mid):
    rows = tier3.s26_geo_concentration(loans_mid).collect()
    assert [r["state_rank"] for r in rows] == list(range(1, len(rows) + 1))
    assert rows[-1]["cumulative_volume_pct"] == sum(r["volume_share_pct"] for r in rows)
    tiers = [r["concentration_tier"] for r in rows]
    assert tiers[:10] == ["Top 10 States"] * 10 and tiers[10:25] == ["Top 25 States"] * 15


def test_s31_ranks_start_at_one(spark, loans_mid):
    rows = tier4.s31_geo_risk(loans_mid).collect()
    for c in ("default_rate_rank", "volume_rank", "interest_rate_rank"):
        assert min(r[c] for r in rows) == 1
    assert all(r["total_loans"] >= 5 for r in rows)


def test_s30_stressed_at_least_baseline(spark, loans_mid):
    rows = tier4.s30_stress_test(loans_mid).collect()
    base = rows[0]
    assert base["scenario"] == "Baseline (Actual)"
    for r in rows[1:]:
        assert r["actual_losses"] >= base["actual_losses"]
        assert r["current_default_rate"] >= base["current_default_rate"]


def test_s23_having_caps_loans(spark, loans_mid):
    rows = tier3.s23_repeat_borrower_history(loans_mid).collect()
    assert max(r["total_loans"] for r in rows) <= 10


def test_results_come_back_in_the_reference_order(spark, loans_mid):
    r = tier2.s11_term_optimization(loans_mid).collect()
    assert [x["term"] for x in r] == sorted(x["term"] for x in r)
    r = tier3.s24_monthly_seasonality(loans_mid).collect()
    keys = [(x["origination_year"] or -1, x["origination_month"] or -1) for x in r]
    assert keys == sorted(keys, reverse=True)
    r = tier4.s27_credit_utilization(loans_mid).collect()
    assert [x["utilization_bucket"] for x in r] == ["0–10%", "11–30%", "31–50%", "51–70%",
                                                    "71–90%", "91–100%+"]
    r = tier2.s13_investor_concentration(loans_mid).collect()
    assert [x["loan_count"] for x in r] == sorted((x["loan_count"] for x in r), reverse=True)


def test_s01_with_a_cutoff_inside_the_data(spark, loans_mid, duck_mid):
    """The reference's cutoff (2009-12-31) is after all test data; the same
    function with an earlier cutoff is checked against the oracle text."""
    import datetime as dt

    from verify import compare
    df = tier1.s01_post2009_snapshot(loans_mid, since=dt.date(2001, 1, 1))
    sql = tier1.SQL["s01_post2009_snapshot"].replace("DATE '2009-12-31'", "DATE '2001-01-01'")
    rep = compare(df, sql, duck_mid)
    assert rep["ok"] and rep["spark_rows"] > 1000, rep


def test_s33_cuts_on_the_exact_ratio(spark):
    # 15.00000025 %: above the cut, though six decimals of the ratio say 15
    rows = [{"monthly_loan_payment": "30000.02", "stated_monthly_income": "200000.13", "loan_status": "Current"},
            {"monthly_loan_payment": "15.00", "stated_monthly_income": "100.00", "loan_status": "Current"}]
    out = {r["pti_bucket"]: r["loan_count"] for r in tier4.s33_payment_to_income(make_loans(spark, rows)).collect()}
    assert out == {"Low (16–25%)": 1, "Very Low (≤15%)": 1}


def test_s34_keeps_wide_ratios(spark):
    rows = [{"occupation": "Pilot", "employment_status": "Employed", "loan_original_amount": "10000.00",
             "stated_monthly_income": "83.00", "loan_status": "Current"}] * 100
    assert tier4.s34_occupation_risk(make_loans(spark, rows)).first()["loan_to_annual_income_ratio"] == Decimal("1004.02")


def test_s01_in_range_has_rows_on_the_cutoff(spark, loans_mid):
    rows = tier1.s01_snapshot_in_range(loans_mid)
    assert rows.where(F.col("loan_origination_date") == F.lit(tier1.SNAPSHOT_IN_RANGE)).count() > 0
    assert 0 < rows.count() < loans_mid.count()


def test_a_changed_cut_turns_its_key_red(spark, duck_small, monkeypatch):
    import dataclasses

    import __spark_entry__ as E
    from loanlens.functions import buckets as B
    from verify import compare
    from conftest import SF_SMALL
    (op, cut, label), *rest = B.DTI_RANGE.rules
    monkeypatch.setattr(B, "DTI_RANGE", dataclasses.replace(B.DTI_RANGE, rules=((op, cut + Decimal("0.02"), label), *rest)))
    rep = compare(E.queries()["s18_dti_delinquency"](spark, SF_SMALL), E.oracle_sql()["s18_dti_delinquency"], duck_small)
    assert not rep["ok"]
