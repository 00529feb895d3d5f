"""Analyses that need more than the reference's own statements: text under a database
collation, as-of and interval joins, windows over raw rows.

Each is a function of (spark, sf_dir) beside its DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.functions import canon as K
from loanlens.functions.collation import CASE_AND_BLANKS, collated
from loanlens.functions.dates import iso_dates
from loanlens.functions.semistructured import parsed, store, typed
from loanlens.operators.joins import interval_join
from loanlens.operators import snapshots
from loanlens.operators.ranges import asof_join, windows
from loanlens.operators.summaries import cube, estimates, exact_percentiles, largest, merged, sketches
from loanlens.plans import sqlkit as S
from loanlens.plans import statements
from loanlens.plans import tier1, tier3
from loanlens.plans.tier1 import s04_status_summary, s06_yearly_trend
from loanlens.plans.tier2 import s07_rating_vs_default
from loanlens.plans.tier3 import s24_monthly_seasonality
from loanlens.plans.tier4 import s36_borrower_progression
from loanlens.session import checkpoint_dir
from loanlens.sources.loans import loans
from loanlens.sources.tables import read_table

# --- collation ----------------------------------------------------------------

#: Text columns that files of several origins spell in several ways.
SPELLED = ("loan_status", "risk_rating", "employment_status", "occupation", "income_range")


def respelled(df: DataFrame) -> DataFrame:
    """The loan table as if from four sources: as it is, in capitals with a blank behind, in small letters, with two blanks behind."""
    source = F.col("loan_number") % 4

    def spelled(c: str) -> F.Column:
        x = F.col(c)
        return F.when(source == 0, x).when(source == 1, F.concat(F.upper(x), F.lit(" "))).when(source == 2, F.lower(x)).otherwise(
            F.concat(x, F.lit("  ")))
    return df.withColumns({c: spelled(c) for c in SPELLED})


def _respelled_loans(spark: SparkSession, sf_dir: str, collation: str | None) -> DataFrame:
    return collated(respelled(loans(spark, sf_dir)), collation)


def c01_status_summary_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s04 over text of several spellings, with case and trailing blanks ignored: one group a status."""
    return s04_status_summary(_respelled_loans(spark, sf_dir, CASE_AND_BLANKS))


def c02_status_summary_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a collation: one group a spelling."""
    return s04_status_summary(_respelled_loans(spark, sf_dir, None))


def c03_rating_default_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s07 (``IN`` and ``GROUP BY`` on text) under the collation."""
    return s07_rating_vs_default(_respelled_loans(spark, sf_dir, CASE_AND_BLANKS))


def c04_borrower_progression_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s36 (``=``, ``IN`` and ``LIKE`` on text) under the collation: as over one spelling."""
    return s36_borrower_progression(_respelled_loans(spark, sf_dir, CASE_AND_BLANKS))


def redated(df: DataFrame) -> DataFrame:
    """The loan table with its raw dates written in six ways, as files of several origins have them."""
    day, raw = F.col("loan_origination_date"), F.col("loan_origination_raw")
    way = F.when(K.safe_timestamp(raw).isNotNull(), F.col("loan_number") % 6)
    texts = (raw, F.date_format(day, "MM/dd/yyyy"), F.concat(F.date_format(day, "MMM d yyyy"), F.lit(" 12:00AM")), F.date_format(day, "dd-MMM-yyyy"),
             F.date_format(day, "yyyyMMdd"), F.date_format(day, "MMMM d, yyyy"))
    written = raw
    for i, text in enumerate(texts):
        written = F.when(way == i, text).otherwise(written)
    return df.withColumn("loan_origination_raw", written)


def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans of several origins, stored as they came, and stored again with their dates rewritten."""
    checkpoint_dir(spark)
    came = redated(loans(spark, sf_dir)).checkpoint(eager=True)
    return iso_dates(came, "loan_origination_raw").checkpoint(eager=True)


def f01_yearly_trend_mixed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s06 over raw dates of six forms, rewritten as they come in: as over one."""
    return s06_yearly_trend(_imported(spark, sf_dir))


def f02_monthly_seasonality_mixed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s24 over raw dates of six forms, rewritten as they come in: as over one."""
    return s24_monthly_seasonality(_imported(spark, sf_dir))


# --- as-of and interval joins ---------------------------------------------------

def j01_events_asof_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the user's last order up to then."""
    orders = (read_table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", "o_orderdate", "o_totalprice"))
    events = read_table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    out = asof_join(events, orders, left_time="ts", right_time="o_orderdate", by=["user_id"], tie=["o_orderkey"])
    return out.select("event_id", "user_id", "event_type", "right_o_orderkey", "right_o_totalprice",
                      K.day_diff("right_o_orderdate", "ts").cast("int").alias("days_since_order"))


def j02_last_loss_in_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each loan with the last loss in the borrower's state that was closed up to its origination."""
    all_loans = loans(spark, sf_dir).select("loan_number", "loan_status", "borrower_state", "loan_origination_date", "closed_date", "lp_net_principal_loss")
    losses = all_loans.where(K.is_bad()).select("borrower_state", "closed_date", "loan_number", "lp_net_principal_loss")
    out = asof_join(all_loans.select("loan_number", "borrower_state", "loan_origination_date"), losses, left_time="loan_origination_date",
                    right_time="closed_date", by=["borrower_state"], tie=["loan_number"], prefix="loss_")
    return out.select("loan_number", "borrower_state", "loan_origination_date", F.col("loss_loan_number").alias("loss_loan"),
                      F.col("loss_closed_date").alias("loss_date"), F.col("loss_lp_net_principal_loss").alias("net_loss"))


def j03_stacked_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans that a borrower took while others were open: how many, and their amount."""
    df = loans(spark, sf_dir)
    taken = df.select("member_key", "loan_number", "loan_origination_date")
    open_ = df.select("member_key", F.col("loan_number").alias("other"), "loan_original_amount", "loan_origination_date", "closed_date")
    pairs = interval_join(taken, open_, at="loan_origination_date", start="loan_origination_date", end="closed_date", by=["member_key"], prefix="open_")
    return (pairs.where("loan_number <> open_other").groupBy("member_key", "loan_number")
            .agg(F.count(F.lit(1)).alias("open_loans"), F.sum("open_loan_original_amount").cast("decimal(38,2)").alias("open_amount")))


# --- windows over raw rows --------------------------------------------------------

def w01_running_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All loans in order of origination: running amount, neighbours, moving sum, hundredths of the portfolio."""
    df = loans(spark, sf_dir).select("loan_number", "loan_origination_date", "loan_original_amount")
    out = windows(df, ["loan_origination_date", "loan_number"], row_number="loan_rank", dense_rank="date_rank", ntile={"hundredth": 100},
                  running_sum={"running_amount": "loan_original_amount"}, moving_sum={"last_ten": ("loan_original_amount", 9)},
                  lag={"before": ("loan_original_amount", 1), "before_3": ("loan_number", 3)}, lead={"next_2": ("loan_number", 2)},
                  first_value={"first_loan": "loan_number"}, last_value={"last_loan": "loan_number"})
    return out.withColumns({c: F.col(c).cast("decimal(38,2)") for c in ("running_amount", "last_ten")})


def w02_borrower_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each borrower's loans in order: amount borrowed so far, the loan before and after, quarter of the sequence."""
    df = loans(spark, sf_dir).select("member_key", "loan_number", "loan_origination_date", "loan_original_amount")
    out = windows(df, ["loan_origination_date", "loan_number"], ["member_key"], row_number="sequence", dense_rank="date_rank",
                  ntile={"quarter_of_sequence": 4}, running_sum={"borrowed": "loan_original_amount"},
                  moving_sum={"last_three": ("loan_original_amount", 2)}, lag={"previous": ("loan_original_amount", 1)},
                  lead={"following": ("loan_number", 1)}, first_value={"first_loan": "loan_number"}, last_value={"last_loan": "loan_number"})
    return out.withColumns({c: F.col(c).cast("decimal(38,2)") for c in ("borrowed", "last_three")})


# --- summaries of groups of any size ----------------------------------------------

def p01_amount_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact median, 90th and 99th percentile of the loan amount per status."""
    return exact_percentiles(loans(spark, sf_dir), ["loan_status"], "loan_original_amount", {"median": "0.5", "p90": "0.9", "p99": "0.99"})


def p02_line_price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles of the price of all lines by return flag."""
    lines = read_table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").cast("decimal(15,2)").alias("price"))
    return exact_percentiles(lines, ["l_returnflag"], "price", {"least": 0, "q1": "0.25", "median": "0.5", "q3": "0.75", "most": 1})


def q01_portfolio_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans, amounts and losses by every subset of status, rating, term and year."""
    df = loans(spark, sf_dir).select("loan_status", "risk_rating", "term", F.year("loan_origination_date").alias("year"), "loan_original_amount",
                                     "lp_net_principal_loss", "borrower_apr")
    return cube(df, ["loan_status", "risk_rating", "term", "year"], {"amount": F.col("loan_original_amount").cast("decimal(28,2)"),
                "net_loss": F.col("lp_net_principal_loss").cast("decimal(28,2)")}, {"least_apr": F.col("borrower_apr")}, {"most_apr": F.col("borrower_apr")}, count="loans")


def t01_largest_loans_by_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten largest loans of each state."""
    df = loans(spark, sf_dir).select("borrower_state", "loan_number", "loan_original_amount", "loan_status")
    return largest(df, ["borrower_state"], [F.desc("loan_original_amount"), F.asc("loan_number")], 10, "size_rank")


def k01_status_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates per status from sketches stored by status and month: borrowers, median and 99th percentile of the amount in cents."""
    df = loans(spark, sf_dir).withColumn("month", F.trunc("loan_origination_date", "month"))
    by_month = sketches(df, ["loan_status", "month"], {"borrowers": "member_key"}, {"cents": F.col("loan_original_amount") * 100})
    stored = f"{checkpoint_dir(spark)}/sketches-{spark._jvm.java.util.UUID.randomUUID()}"
    by_month.write.parquet(stored)
    by_status = merged(spark.read.parquet(stored), ["loan_status"], ["borrowers"], ["cents"])
    return estimates(by_status, ["loan_status"], ["borrowers"], {"cents": [0.5, 0.99]})


def v01_events_by_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their value by a typed path of ``props``; a tenth of the texts is cut short, a tenth holds text for the number."""
    kind = F.col("event_id") % 10
    events = read_table(spark, sf_dir, "events").select("event_id", "event_type", F.rint(F.col("value") * 100).cast("long").alias("cents"), F.when(
        kind == 3, F.substring("props", 1, 3)).when(kind == 4, F.lit('{"k": "many", "other": [1, 2]}')).otherwise(F.col("props")).alias("props"))
    table = store(parsed(events, "props"), f"{checkpoint_dir(spark)}/events-{spark._jvm.java.util.UUID.randomUUID()}")
    return (typed(table, "props", {"k": ("$.k", "int"), "second": ("$.other[1]", "long")}).groupBy("event_type", "k")
            .agg(F.count(F.lit(1)).alias("events"), F.sum("cents").alias("cents"), F.sum("second").alias("seconds")))


def d01_loan_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a later snapshot of the loans added, removed and changed: closed loans go, late ones change, new ones come."""
    now = loans(spark, sf_dir).select("loan_number", "loan_status", "loan_original_amount", "closed_date")
    number = F.col("loan_number")
    before = now.where(number % 300 != 5)
    after = now.where(number % 200 != 7).withColumn("loan_status", F.when((number % 500 == 11), F.lit("Completed")).otherwise(F.col("loan_status")))
    folder = f"{checkpoint_dir(spark)}/snapshots-{spark._jvm.java.util.UUID.randomUUID()}"
    for name, rows in (("old", before), ("new", after)):
        snapshots.store(rows, f"{folder}/{name}", ["loan_number"], buckets=16)
    return snapshots.difference(spark, f"{folder}/old", f"{folder}/new", ["loan_number"])


# --- oracles ------------------------------------------------------------------------

def _spelled_sql(c: str) -> str:
    return (f"CASE loan_number % 4 WHEN 0 THEN {c} WHEN 1 THEN upper({c}) || ' ' WHEN 2 THEN lower({c}) ELSE {c} || '  ' END AS {c}")


_RESPELLED = f"""WITH spelled AS (
 SELECT * REPLACE ({', '.join(_spelled_sql(c) for c in SPELLED)}) FROM loan)"""
_FOLDED_BAD = "lower(rtrim(loan_status)) IN ('defaulted', 'chargedoff')"


def _summary(key: str) -> str:
    return f"""{_RESPELLED}
SELECT min(loan_status) AS loan_status,
       {S.N} AS total_loans,
       CAST(COUNT(DISTINCT member_key) AS BIGINT) AS unique_borrowers,
       {S.avg_x('loan_original_amount')} AS avg_loan_amount,
       MIN(loan_original_amount) AS min_loan_amount, MAX(loan_original_amount) AS max_loan_amount,
       {S.avg_x('CAST(borrower_apr AS DECIMAL(10,4))')} AS avg_borrower_apr,
       {S.avg_x('monthly_loan_payment')} AS avg_monthly_payment,
       {S.pct('COUNT(*)', '(SELECT COUNT(*) FROM loan)')} AS portfolio_share_pct
FROM spelled GROUP BY {key}"""


def _over(order: str, partition: str = "") -> str:
    return f"({f'PARTITION BY {partition} ' if partition else ''}ORDER BY {order}"


_IN_ORDER = "loan_origination_date, loan_number"

SQL = {
    "c01_status_summary_collated": S.over_loans(_summary("lower(rtrim(loan_status))")),
    "c02_status_summary_binary": S.over_loans(_summary("loan_status")),
    "c03_rating_default_collated": S.over_loans(f"""{_RESPELLED}
SELECT min(risk_rating) AS risk_rating, {S.N} AS total_loans, {S.avg_x('borrower_apr')} AS avg_borrower_apr,
       {S.avg_x(S.flag(_FOLDED_BAD))} AS default_rate, {S.avg_x('lender_yield')} AS avg_lender_yield
FROM spelled WHERE risk_rating IS NOT NULL GROUP BY lower(rtrim(risk_rating))"""),
    # one spelling throughout: the analysis must not see the others
    "c04_borrower_progression_collated": statements.SQL["s36_borrower_progression"],
    "f01_yearly_trend_mixed_dates": tier1.SQL["s06_yearly_trend"],
    "f02_monthly_seasonality_mixed_dates": (tier3.SQL | statements.SQL)["s24_monthly_seasonality"],
    "j01_events_asof_orders": """
WITH last_of_day AS (
  SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL),
days AS (SELECT l.*, o.o_totalprice FROM last_of_day l JOIN orders o USING (o_custkey, o_orderdate, o_orderkey))
SELECT event_id, user_id, event_type, o_orderkey AS right_o_orderkey, o_totalprice AS right_o_totalprice,
       CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(ts AS DATE)) AS INTEGER) AS days_since_order
FROM events ASOF LEFT JOIN days ON user_id = o_custkey AND ts >= o_orderdate""",
    "j02_last_loss_in_state": S.over_loans(f"""
WITH losses AS (
  SELECT borrower_state, closed_date, max(loan_number) AS loan_number, arg_max(lp_net_principal_loss, loan_number) AS net_loss
  FROM loan WHERE {S.BAD} AND closed_date IS NOT NULL GROUP BY borrower_state, closed_date)
SELECT l.loan_number, l.borrower_state, l.loan_origination_date, x.loan_number AS loss_loan, x.closed_date AS loss_date, x.net_loss
FROM loan l ASOF LEFT JOIN losses x ON l.borrower_state = x.borrower_state AND l.loan_origination_date >= x.closed_date"""),
    "j03_stacked_loans": S.over_loans("""
SELECT a.member_key, a.loan_number, CAST(count(*) AS BIGINT) AS open_loans, CAST(sum(b.loan_original_amount) AS DECIMAL(38,2)) AS open_amount
FROM loan a JOIN loan b ON a.member_key = b.member_key AND a.loan_number <> b.loan_number
 AND a.loan_origination_date >= b.loan_origination_date AND a.loan_origination_date < b.closed_date
GROUP BY a.member_key, a.loan_number"""),
    "w01_running_portfolio": S.over_loans(f"""
SELECT loan_number, loan_origination_date, loan_original_amount,
       row_number() OVER {_over(_IN_ORDER)}) AS loan_rank,
       dense_rank() OVER {_over('loan_origination_date')}) AS date_rank,
       ntile(100) OVER {_over(_IN_ORDER)}) AS hundredth,
       CAST(sum(loan_original_amount) OVER {_over(_IN_ORDER)} ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,2)) AS running_amount,
       CAST(sum(loan_original_amount) OVER {_over(_IN_ORDER)} ROWS 9 PRECEDING) AS DECIMAL(38,2)) AS last_ten,
       lag(loan_original_amount) OVER {_over(_IN_ORDER)}) AS before, lag(loan_number, 3) OVER {_over(_IN_ORDER)}) AS before_3,
       lead(loan_number, 2) OVER {_over(_IN_ORDER)}) AS next_2,
       first_value(loan_number) OVER {_over(_IN_ORDER)}) AS first_loan,
       last_value(loan_number) OVER {_over(_IN_ORDER)} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_loan
FROM loan"""),
    "w02_borrower_sequence": S.over_loans(f"""
SELECT member_key, loan_number, loan_origination_date, loan_original_amount,
       row_number() OVER {_over(_IN_ORDER, 'member_key')}) AS sequence,
       dense_rank() OVER {_over('loan_origination_date', 'member_key')}) AS date_rank,
       ntile(4) OVER {_over(_IN_ORDER, 'member_key')}) AS quarter_of_sequence,
       CAST(sum(loan_original_amount) OVER {_over(_IN_ORDER, 'member_key')} ROWS UNBOUNDED PRECEDING) AS DECIMAL(38,2)) AS borrowed,
       CAST(sum(loan_original_amount) OVER {_over(_IN_ORDER, 'member_key')} ROWS 2 PRECEDING) AS DECIMAL(38,2)) AS last_three,
       lag(loan_original_amount) OVER {_over(_IN_ORDER, 'member_key')}) AS previous,
       lead(loan_number) OVER {_over(_IN_ORDER, 'member_key')}) AS following,
       first_value(loan_number) OVER {_over(_IN_ORDER, 'member_key')}) AS first_loan,
       last_value(loan_number) OVER {_over(_IN_ORDER, 'member_key')} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_loan
FROM loan"""),
    "p01_amount_percentiles": S.over_loans("""
SELECT loan_status, quantile_disc(loan_original_amount, 0.5) AS median, quantile_disc(loan_original_amount, 0.9) AS p90,
       quantile_disc(loan_original_amount, 0.99) AS p99 FROM loan GROUP BY loan_status"""),
    "p02_line_price_percentiles": """
SELECT l_returnflag, min(price) AS least, quantile_disc(price, 0.25) AS q1, quantile_disc(price, 0.5) AS median, quantile_disc(price, 0.75) AS q3,
       max(price) AS most FROM (SELECT l_returnflag, CAST(l_extendedprice AS DECIMAL(15,2)) AS price FROM lineitem) GROUP BY l_returnflag""",
    "q01_portfolio_cube": S.over_loans("""
SELECT loan_status, risk_rating, term, year, grouping_id(loan_status, risk_rating, term, year) AS grouping_id, count(*) AS loans,
       CAST(sum(loan_original_amount) AS DECIMAL(38,2)) AS amount, CAST(sum(lp_net_principal_loss) AS DECIMAL(38,2)) AS net_loss,
       min(borrower_apr) AS least_apr, max(borrower_apr) AS most_apr
FROM (SELECT *, CAST(year(loan_origination_date) AS INTEGER) AS year FROM loan) GROUP BY CUBE (loan_status, risk_rating, term, year)"""),
    "t01_largest_loans_by_state": S.over_loans("""
SELECT * FROM (
  SELECT borrower_state, loan_number, loan_original_amount, loan_status,
         CAST(row_number() OVER (PARTITION BY borrower_state ORDER BY loan_original_amount DESC, loan_number) AS INTEGER) AS size_rank FROM loan)
WHERE size_rank <= 10"""),
    "v01_events_by_property": """
SELECT event_type, k, CAST(count(*) AS BIGINT) AS events, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents,
       CAST(sum(CASE WHEN event_id % 10 = 4 THEN 2 END) AS BIGINT) AS seconds
FROM (SELECT *, CASE WHEN event_id % 10 NOT IN (3, 4) THEN TRY_CAST(regexp_extract(props, '"k": *(-?[0-9]+) *[,}]', 1) AS INTEGER) END AS k FROM events)
GROUP BY event_type, k""",
    "d01_loan_changes": S.over_loans("""
WITH slim AS (SELECT loan_number, loan_status, loan_original_amount, closed_date FROM loan),
old AS (SELECT * FROM slim WHERE loan_number % 300 <> 5),
new AS (SELECT * REPLACE (CASE WHEN loan_number % 500 = 11 THEN 'Completed' ELSE loan_status END AS loan_status) FROM slim WHERE loan_number % 200 <> 7),
gone AS (SELECT * FROM old EXCEPT ALL SELECT * FROM new), come AS (SELECT * FROM new EXCEPT ALL SELECT * FROM old)
SELECT *, CASE WHEN loan_number IN (SELECT loan_number FROM new) THEN 'changed from' ELSE 'removed' END AS change, CAST(1 AS BIGINT) AS copies FROM gone
UNION ALL
SELECT *, CASE WHEN loan_number IN (SELECT loan_number FROM old) THEN 'changed to' ELSE 'added' END, CAST(1 AS BIGINT) FROM come"""),
}

FUNCS = {f.__name__: f for f in (
    f01_yearly_trend_mixed_dates, f02_monthly_seasonality_mixed_dates, c01_status_summary_collated, c02_status_summary_binary, c03_rating_default_collated, c04_borrower_progression_collated,
    j01_events_asof_orders, j02_last_loss_in_state, j03_stacked_loans, w01_running_portfolio, w02_borrower_sequence,
    p01_amount_percentiles, p02_line_price_percentiles, q01_portfolio_cube, t01_largest_loans_by_state, k01_status_sketches,
    v01_events_by_property, d01_loan_changes)}
