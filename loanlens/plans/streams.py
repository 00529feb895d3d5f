"""Streaming queries over the given tables, each beside the SQL of its result.

The table is dealt into drops that come in order of time, with rows out of order by up
to ``JITTER_S`` and stragglers that come two drops late. Each drop is written to a landing
folder and processed to its end before the next one lands, by a query that is started
again from its checkpoint every time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loanlens.plans import statements
from loanlens.session import checkpoint_dir
from loanlens.sources.loans import loans
from loanlens.sources.tables import read_table
from loanlens.streaming.borrower_state import BorrowerStream
from loanlens.streaming.event_windows import STATE_PARTITIONS, EventWindows, WindowStream

DROPS, JITTER_S, DELAY_S, STRAGGLERS = 4, 6 * 3600, 12 * 3600, 40
#: Loans of a state partition, and of a group of borrowers.
STATE_LOANS, GROUP_LOANS = 2_000_000, 4_000

_MEASURES = {"events": "count(*)", "value_cents": "sum(CAST(rint(value * 100) AS BIGINT))"}
HOURLY = EventWindows(["event_type"], _MEASURES, width="1 hour")
SLIDING = EventWindows(["event_type"], _MEASURES, width="6 hours", slide="2 hours")
SESSIONS = EventWindows(["user_id"], _MEASURES, gap="6 hours")


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{spark._jvm.java.util.UUID.randomUUID()}"


def dealt(events: DataFrame, drops: int = DROPS) -> DataFrame:
    """``events`` with the number of the drop that each row comes in."""
    lo, hi = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    span = (hi or 0) - (lo or 0) + 1
    moved = F.unix_micros("ts") - F.lit(lo or 0) + (F.col("event_id") * 7919 % JITTER_S) * 1_000_000
    on_time = F.call_function("div", moved * drops, F.lit(span))
    late = F.when(F.col("event_id") % STRAGGLERS == 7, 2).otherwise(0)
    return events.withColumn("drop", F.least(on_time + late, F.lit(drops - 1).cast("long")))


def streamed(spark: SparkSession, sf_dir: str, windows: EventWindows, name: str) -> WindowStream:
    """``events`` through a stream, drop by drop, all windows closed at the end."""
    events = read_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = _folder(spark, name)
    stream = WindowStream(spark, windows, events.schema, f"{folder}/landing", folder, f"{DELAY_S} seconds")
    rows = dealt(events)
    for drop in range(DROPS):
        rows.where(F.col("drop") == drop).drop("drop").write.parquet(f"{folder}/landing/drop-{drop}")
        stream.run()
    stream.flush()
    return stream


def _without_zone(windows: DataFrame) -> DataFrame:
    """Window bounds as the table's own times are."""
    return windows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


def e01_hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their value by hour and type, late rows left out."""
    return _without_zone(streamed(spark, sf_dir, HOURLY, "hourly").result())


def e02_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over six hours, every two hours."""
    return _without_zone(streamed(spark, sf_dir, SLIDING, "sliding").result())


def e03_user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user, which end after six hours without an event."""
    return _without_zone(streamed(spark, sf_dir, SESSIONS, "sessions").result())


def e04_late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that the stream dropped as late, and those in its windows."""
    stream = streamed(spark, sf_dir, HOURLY, "late")
    return stream.result().agg(F.coalesce(F.sum("events"), F.lit(0)).alias("timely_rows")).withColumn("late_rows", F.lit(stream.late_rows).cast("long"))


def e05_borrower_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s36 from the borrowers' states after all loans have come, drop by drop."""
    folder = _folder(spark, "borrowers")
    rows = loans(spark, sf_dir).withColumn("drop", F.col("loan_number") % DROPS)
    # derived once, not once a drop
    rows.write.partitionBy("drop").parquet(f"{folder}/dealt")
    rows = spark.read.schema(rows.schema).parquet(f"{folder}/dealt")
    n = rows.count()
    stream = BorrowerStream(spark, f"{folder}/landing", folder, partitions=max(STATE_PARTITIONS, n // STATE_LOANS),
                            groups=max(STATE_PARTITIONS, n // GROUP_LOANS))
    for drop in range(DROPS):
        rows.where(F.col("drop") == drop).drop("drop").write.parquet(f"{folder}/landing/drop-{drop}")
        stream.run()
    return stream.progression()


_TIMELY = f"""
WITH bounds AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events),
dealt AS (
  SELECT events.*, least((epoch_us(ts) - lo + (event_id * 7919 % {JITTER_S}) * 1000000) * {DROPS} // (hi - lo + 1)
         + CASE WHEN event_id % {STRAGGLERS} = 7 THEN 2 ELSE 0 END, {DROPS - 1}) AS arrives
  FROM events, bounds),
marks AS (
  SELECT d.arrives, max(epoch_us(e.ts)) // 1000 * 1000 - {DELAY_S * 1_000_000} AS mark
  FROM (SELECT DISTINCT arrives FROM dealt) d JOIN dealt e ON e.arrives < d.arrives GROUP BY d.arrives),
timely AS (SELECT dealt.* FROM dealt LEFT JOIN marks USING (arrives) WHERE mark IS NULL OR epoch_us(ts) > mark)"""
_SUMS = "CAST(count(*) AS BIGINT) AS events, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_cents"

SQL = {
    "e01_hourly_windows": _TIMELY + f"""
SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS window_start, CAST(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS TIMESTAMP) AS window_end, event_type, {_SUMS}
FROM timely GROUP BY ALL""",
    "e02_sliding_windows": _TIMELY + f""",
placed AS (SELECT timely.*, time_bucket(INTERVAL 2 HOUR, ts) - back * INTERVAL 2 HOUR AS opens FROM timely, (SELECT unnest([0, 1, 2]) AS back))
SELECT CAST(opens AS TIMESTAMP) AS window_start, CAST(opens + INTERVAL 6 HOUR AS TIMESTAMP) AS window_end, event_type, {_SUMS}
FROM placed GROUP BY ALL""",
    "e03_user_sessions": _TIMELY + f""",
breaks AS (
  SELECT timely.*, coalesce(CAST(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 6 HOUR AS INT), 1) AS opens FROM timely),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM breaks)
SELECT CAST(min(ts) AS TIMESTAMP) AS window_start, CAST(max(ts) + INTERVAL 6 HOUR AS TIMESTAMP) AS window_end, user_id, {_SUMS}
FROM numbered GROUP BY user_id, session""",
    "e04_late_rows": _TIMELY + """
SELECT CAST((SELECT count(*) FROM timely) AS BIGINT) AS timely_rows, CAST((SELECT count(*) FROM events) - (SELECT count(*) FROM timely) AS BIGINT) AS late_rows""",
    "e05_borrower_state": statements.SQL["s36_borrower_progression"],
}

FUNCS = {f.__name__: f for f in (e01_hourly_windows, e02_sliding_windows, e03_user_sessions, e04_late_rows, e05_borrower_state)}
