"""SQL text for the DuckDB oracles.

Every analysis has an equivalent SQL statement that DuckDB runs on the same
Parquet tables. The loan table is inlined as CTEs (``li``, ``base``,
``loan``) exactly as specified in FIXTURES.md; the helpers below emit the
SQL spelling of each canonical form of SURVEY 2.5. No constant, ladder or
formula of the Spark code is imported: ladders stand as literals in the
statements, and percentages are integer quotients and remainders.
"""

from __future__ import annotations

LOAN_CTE = """WITH li AS (
 SELECT l_orderkey,
  count(*) AS n_lines,
  sum(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS n_ret,
  cast(max(l_discount) AS decimal(10,4)) AS mx_disc,
  cast(min(l_discount) AS decimal(10,4)) AS mn_disc,
  cast(max(l_tax) AS decimal(10,4)) AS mx_tax,
  cast(sum(cast(l_quantity AS decimal(10,2))) AS decimal(12,2)) AS qty,
  cast(sum(cast(l_extendedprice AS decimal(15,2))) AS decimal(15,2)) AS ext,
  cast(sum(CASE WHEN l_returnflag='R' THEN cast(l_extendedprice AS decimal(15,2)) ELSE cast(0 AS decimal(15,2)) END) AS decimal(15,2)) AS ext_r,
  cast(sum(CASE WHEN l_returnflag='A' THEN cast(l_extendedprice AS decimal(15,2)) ELSE cast(0 AS decimal(15,2)) END) AS decimal(15,2)) AS ext_a,
  cast(sum(CASE WHEN l_linestatus='F' THEN cast(l_extendedprice AS decimal(15,2)) ELSE cast(0 AS decimal(15,2)) END) AS decimal(15,2)) AS ext_f,
  max(l_shipdate) AS mx_ship
 FROM lineitem GROUP BY l_orderkey),
base AS (
 SELECT o.*, c.*, n.n_name, li.*,
  CASE WHEN o_orderstatus='F' AND o_orderpriority='1-URGENT' THEN 'Defaulted'
       WHEN o_orderstatus='F' AND o_orderpriority='2-HIGH' THEN 'Chargedoff'
       WHEN o_orderstatus='F' THEN 'Completed'
       WHEN o_orderstatus='P' AND o_orderpriority='1-URGENT' THEN 'Past Due (1-15 days)'
       WHEN o_orderstatus='P' AND o_orderpriority='2-HIGH' THEN 'Past Due (>120 days)'
       WHEN o_orderstatus='P' AND o_orderpriority='5-LOW' THEN 'Cancelled'
       ELSE 'Current' END AS st
 FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey
 LEFT JOIN nation n ON c.c_nationkey=n.n_nationkey
 LEFT JOIN li ON o.o_orderkey=li.l_orderkey),
loan AS (
SELECT
 cast(o_orderkey AS string) AS listing_key, cast(o_orderkey AS string) AS loan_key, o_orderkey AS loan_number,
 CASE WHEN o_custkey % 211 = 0 THEN NULL ELSE cast(o_custkey AS string) END AS member_key,
 st AS loan_status, cast(o_orderdate AS date) AS loan_origination_date,
 CASE WHEN o_orderkey % 503 = 5 THEN 'not-a-date' WHEN o_orderkey % 509 = 6 THEN NULL ELSE cast(cast(o_orderdate AS date) AS string) END AS loan_origination_raw,
 CASE WHEN st IN ('Completed','Defaulted','Chargedoff') THEN cast(mx_ship AS date) END AS closed_date,
 cast(cast(o_totalprice AS decimal(15,2))*0.1 AS decimal(15,2)) AS loan_original_amount,
 CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 4 = 0 THEN 12 WHEN o_orderkey % 4 = 2 THEN 60 ELSE 36 END AS term,
 cast(cast(o_totalprice AS decimal(15,2))*0.003 AS decimal(15,2)) AS monthly_loan_payment,
 cast(mx_disc+mx_tax+0.05 AS decimal(10,4)) AS borrower_apr, cast(mx_disc+0.05 AS decimal(10,4)) AS borrower_rate,
 cast(mx_disc+0.04 AS decimal(10,4)) AS lender_yield, cast(mx_disc+0.035 AS decimal(10,4)) AS estimated_effective_yield,
 cast(mn_disc AS decimal(10,4)) AS estimated_loss, cast(mx_disc+0.04-mn_disc AS decimal(10,4)) AS estimated_return,
 CASE o_orderkey % 8 WHEN 0 THEN 'AA' WHEN 1 THEN 'A' WHEN 2 THEN 'B' WHEN 3 THEN 'C' WHEN 4 THEN 'D' WHEN 5 THEN 'E' WHEN 6 THEN 'HR' END AS risk_rating,
 cast(o_custkey % 11 AS int) AS platform_score, cast((o_orderkey * 7) % 601 AS int) AS investors,
 cast(CASE WHEN o_orderkey % 10 = 0 THEN 0.85 WHEN o_orderkey % 10 = 1 THEN 1.01 ELSE 1.00 END AS decimal(5,4)) AS percent_funded,
 cast(CASE WHEN o_orderkey % 50 = 0 THEN 1 WHEN o_orderkey % 73 = 0 THEN 2 ELSE 0 END AS int) AS investment_from_friends_count,
 CASE WHEN o_custkey % 100 = 7 THEN NULL WHEN o_custkey % 100 = 8 THEN '' ELSE concat(n_name, '-', cast(o_custkey % 2 AS string)) END AS borrower_state,
 CASE WHEN o_custkey % 53 = 0 THEN NULL WHEN o_custkey % 199 = 3 THEN 'Judge' WHEN c_mktsegment='FURNITURE' THEN 'Other' ELSE c_mktsegment END AS occupation,
 CASE (o_custkey % 37) % 5 WHEN 0 THEN 'Employed' WHEN 1 THEN 'Self-employed' WHEN 2 THEN 'Not employed' WHEN 3 THEN 'Full-time' END AS employment_status,
 cast(CASE WHEN o_custkey % 17 = 0 THEN NULL ELSE o_custkey % 90 END AS int) AS employment_status_duration,
 CASE WHEN o_custkey % 3 = 0 THEN 'True' ELSE 'False' END AS is_borrower_homeowner,
 CASE WHEN c_acctbal < -500 THEN 'Not employed' WHEN c_acctbal < 0 THEN '$0' WHEN c_acctbal < 2000 THEN '$1-24,999' WHEN c_acctbal < 4000 THEN '$25,000-49,999' WHEN c_acctbal < 6000 THEN '$50,000-74,999' WHEN c_acctbal < 8000 THEN '$75,000-99,999' WHEN c_acctbal < 9500 THEN '$100,000+' ELSE 'Not displayed' END AS income_range,
 CASE WHEN o_custkey % 59 = 0 THEN NULL ELSE cast(c_acctbal AS decimal(15,2)) END AS stated_monthly_income,
 cast(qty*0.004 AS decimal(10,4)) AS debt_to_income_ratio,
 cast(CASE WHEN o_custkey % 61 = 0 THEN NULL ELSE 600 + 20 * (o_custkey % 10) END AS int) AS credit_score_range_lower,
 cast(CASE WHEN o_custkey % 61 = 0 THEN NULL ELSE 619 + 20 * (o_custkey % 10) END AS int) AS credit_score_range_upper,
 cast(n_lines AS int) AS open_credit_lines, cast(n_ret AS int) AS current_delinquencies, cast(o_orderkey % 13 AS int) AS delinquencies_last_7_years,
 cast(CASE WHEN o_custkey % 4 = 3 THEN NULL ELSE o_custkey % 4 END AS int) AS public_records_last_10_years,
 cast(CASE WHEN st IN ('Current','Completed','Cancelled') THEN 0 ELSE o_orderkey % 120 END AS int) AS loan_current_days_delinquent,
 cast(CASE WHEN o_orderkey % 71 = 0 THEN NULL ELSE (o_orderkey % 111) * 0.01 END AS decimal(10,4)) AS bankcard_utilization,
 cast(cast(o_totalprice AS decimal(15,2))*0.05 AS decimal(15,2)) AS revolving_credit_balance, cast(ext*0.1 AS decimal(15,2)) AS available_bankcard_credit,
 cast(ext*0.1 AS decimal(15,2)) AS lp_customer_payments, cast(ext_f*0.1 AS decimal(15,2)) AS lp_customer_principal_payments,
 cast((ext-ext_f)*0.01 AS decimal(15,2)) AS lp_interest_and_fees, cast(ext*-0.001 AS decimal(15,2)) AS lp_service_fees, cast(ext_r*-0.0005 AS decimal(15,2)) AS lp_collection_fees,
 cast(CASE WHEN st IN ('Defaulted','Chargedoff') THEN ext_r*0.1 ELSE ext_r*0.0 END AS decimal(15,2)) AS lp_gross_principal_loss,
 cast(CASE WHEN st IN ('Defaulted','Chargedoff') THEN ext_r*0.09 ELSE ext_r*0.0 END AS decimal(15,2)) AS lp_net_principal_loss,
 cast(CASE WHEN st IN ('Defaulted','Chargedoff') THEN ext_a*0.01 ELSE ext_a*0.0 END AS decimal(15,2)) AS lp_non_principal_recovery_payments
FROM base)
"""


def over_loans(body: str) -> str:
    """Oracle text: the loan CTE chain followed by the analysis."""
    body = body.strip()
    if body.upper().startswith("WITH "):
        # the analysis has its own CTEs: continue the chain
        return LOAN_CTE.rstrip() + ",\n" + body[5:]
    return LOAN_CTE + body


def section_body(oracle: str) -> str:
    """The analysis part of an oracle built by ``over_loans`` (expects a
    relation named ``loan``), e.g. to run it over a stored loan table."""
    assert oracle.startswith(LOAN_CTE.rstrip()), "not built by over_loans"
    rest = oracle[len(LOAN_CTE.rstrip()):]
    if rest.startswith(",\n"):
        return "WITH " + rest[2:]
    return rest.lstrip()


# --- canonical forms ----------------------------------------------------------

BAD = "loan_status IN ('Defaulted','Chargedoff')"
CURRENT = "loan_status = 'Current'"
NOT_CURRENT = "loan_status <> 'Current'"
COMPLETED = "loan_status = 'Completed'"
PAST_DUE = "loan_status LIKE 'Past Due%'"
MIDPOINT = "((credit_score_range_lower + credit_score_range_upper) / 2.0)"


def flag(pred: str) -> str:
    return f"CASE WHEN {pred} THEN 1 ELSE 0 END"


def count_if(pred: str) -> str:
    return f"CAST(SUM({flag(pred)}) AS BIGINT)"


N = "CAST(COUNT(*) AS BIGINT)"


def avg_x(x: str) -> str:
    return f"(CAST(SUM({x}) AS DOUBLE) / COUNT({x}))"


def iavg(x: str) -> str:
    return f"CAST(TRUNC(SUM({x})::DECIMAL(38,0) / COUNT({x})) AS BIGINT)"


def iavg_over(x: str, over: str) -> str:
    return f"CAST(SUM({x}) OVER ({over}) // COUNT({x}) OVER ({over}) AS BIGINT)"


def quantize6(x: str) -> str:
    return (f"CAST(CAST(FLOOR(CAST({x} AS DOUBLE) * 1e6 + 0.5) AS DECIMAL(20,0))"
            f" * 0.000001 AS DECIMAL(28,6))")


def ratio6(x: str) -> str:
    return quantize6(x)


def rnd(x: str, d: int, p: int = 18) -> str:
    return f"TRY_CAST(ROUND({quantize6(x)}, {d}) AS DECIMAL({p},{d}))"


def half_up(num: str, den: str, d: int = 2) -> str:
    """Quotient of integer expressions: quotient and remainder, then the remainder's half decides."""
    n, m = f"(abs(({num})::HUGEINT) * {10 ** d})", f"(NULLIF({den}, 0)::HUGEINT)"
    return (f"CAST((CASE WHEN ({num}) < 0 THEN -1 ELSE 1 END * ({n} // {m} + CASE WHEN {n} % {m} * 2 >= {m} THEN 1 ELSE 0 END))"
            f"::DECIMAL(30,0) * {'0.' + '0' * (d - 1) + '1' if d else '1'} AS DECIMAL(18,{d}))")


def pct(num: str, den: str, d: int = 2) -> str:
    """Percentage of integer expressions."""
    return half_up(f"({num})::HUGEINT * 100", den, d)


def total(x: str, scale: int = 2) -> str:
    """Sum of a decimal expression in units of its last place, as an integer."""
    return f"CAST(SUM({x}) * {10 ** scale} AS HUGEINT)"


def mean(x: str, scale: int, d: int, times: int = 1) -> str:
    """Rounded average of a decimal expression with ``scale`` places."""
    return half_up(f"{total(x, scale)} * {times}", f"COUNT({x})::HUGEINT * {10 ** scale}", d)


BAD_PCT = pct(f"COUNT(*) FILTER ({BAD})", "COUNT(*)")


def flag_rate(pred: str) -> str:
    return avg_x(flag(pred))


def guarded_div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / NULLIF(CAST({b} AS DOUBLE), 0))"


def currency(x: str) -> str:
    return f"CASE WHEN {x} < 0 THEN '-' ELSE '' END || format('${{:,.2f}}', abs({x}))"


def month_boundaries(start: str, end: str) -> str:
    return f"((year({end}) - year({start})) * 12 + (month({end}) - month({start})))"
