"""Streams in shuffled files against the batch result: late rows counted, restarts, repeated deliveries, timeouts."""
import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loanlens.plans import registry, streams
from loanlens.sources.loans import derive_loans
from loanlens.streaming.borrower_state import SUMS, BorrowerStream, updated
from loanlens.streaming.event_windows import EventWindows, WindowStream, settings

from conftest import SF_SMALL
from helpers import digest

SCHEMA = "event_id long, ts timestamp, user_id long, value long"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
COUNTS = {"n": "count(*)", "value": "sum(value)"}
KINDS = {"tumbling": EventWindows(["user_id"], COUNTS, width="10 minutes"),
         "sliding": EventWindows(["user_id"], COUNTS, width="30 minutes", slide="10 minutes"),
         "session": EventWindows(["user_id"], COUNTS, gap="7 minutes")}


def events(n=300, seed=2):
    rng = random.Random(seed)
    return [(i, START + dt.timedelta(seconds=rng.randrange(6 * 3600)), rng.choice([1, 1, 1, 2, None]), rng.randrange(100)) for i in range(n)]


def land(spark, rows, folder, name):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/landing/{name}")


def stream(spark, folder, kind, delay):
    from pyspark.sql.types import _parse_datatype_string
    return WindowStream(spark, KINDS[kind], _parse_datatype_string(SCHEMA), f"{folder}/landing", str(folder), delay, partitions=2)


@pytest.mark.parametrize("kind", sorted(KINDS))
def test_shuffled_files_equal_the_batch(spark, tmp_path, kind):
    """Four files in any order, processed one a batch: nothing is late within the delay; repeated deliveries count once."""
    rows = events()
    random.Random(9).shuffle(rows)
    for i in range(4):
        land(spark, rows[i::4] + rows[:20], tmp_path, f"f{i}")
    s = stream(spark, tmp_path, kind, "7 hours")
    s.run(max_files=1)
    assert s.batches >= 4 and s.late_rows == 0
    s.flush()
    assert digest(s.result()) == digest(KINDS[kind].batch(spark.createDataFrame(rows, SCHEMA)))


def test_late_rows_are_dropped_and_counted_and_a_restart_goes_on(spark, tmp_path):
    rows = sorted(events(), key=lambda r: r[1])
    first, second = rows[:150], rows[150:]
    land(spark, first, tmp_path, "a")
    s = stream(spark, tmp_path, "tumbling", "5 minutes")
    s.run()
    mark = max(r[1] for r in first) - dt.timedelta(minutes=5)
    old = [(1000 + i, r[1], r[2], r[3]) for i, r in enumerate(first[:30])] + [(2000, mark, 1, 5), (2001, mark + dt.timedelta(milliseconds=1), 1, 5)]
    land(spark, second + old, tmp_path, "b")
    again = stream(spark, tmp_path, "tumbling", "5 minutes")           # a new object: all it knows is in the checkpoint
    again.run()
    assert again.late_rows == 31 and s.late_rows == 0
    again.flush()
    timely = first + second + [old[-1]]
    assert digest(again.result()) == digest(KINDS["tumbling"].batch(spark.createDataFrame(timely, SCHEMA)))


def test_a_query_stopped_in_the_middle_loses_nothing(spark, tmp_path):
    rows = events(200, 5)
    for i in range(4):
        land(spark, rows[i::4], tmp_path, f"f{i}")
    s = stream(spark, tmp_path, "tumbling", "7 hours")
    q = s.start(max_files=1)
    while q.isActive and not q.recentProgress:
        q.awaitTermination(0.2)
    q.stop()
    s.run(max_files=1)
    s.flush()
    assert digest(s.result()) == digest(KINDS["tumbling"].batch(spark.createDataFrame(rows, SCHEMA)))


def test_session_settings_are_given_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with settings(spark, {"spark.sql.shuffle.partitions": "3", "loanlens.test": "1"}):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and spark.conf.get("loanlens.test", None) is None


@pytest.mark.parametrize("idle_ms", [30 * 24 * 3600 * 1000, 1])
def test_profiles_equal_s36_after_every_batch(spark, tmp_path, idle_ms):
    """Also where every state times out between the drops: generations add up. A hot borrower holds a third of the loans."""
    hot = F.when(F.col("loan_number") % 7 < 2, F.lit("hot")).otherwise(F.col("member_key"))
    # every other borrower has nothing in the second drop
    absent = (F.col("loan_number") % 3 == 1) & (F.crc32("member_key") % 2 == 0)
    df = derive_loans(spark, SF_SMALL).withColumn("member_key", hot).withColumn(
        "drop", F.when(absent, 2).otherwise(F.col("loan_number") % 3)).cache()
    s36 = registry.loan_functions()["s36_borrower_progression"]
    s = BorrowerStream(spark, f"{tmp_path}/landing", str(tmp_path), idle_ms=idle_ms, partitions=2)
    for drop in range(3):
        df.where(F.col("drop") == drop).drop("drop").write.parquet(f"{tmp_path}/landing/d{drop}")
        s.run()
        so_far = df.where(F.col("drop") <= drop)
        assert digest(s.progression()) == digest(s36(so_far))
    generations = spark.read.parquet(f"{tmp_path}/profiles").select("member_key", "generation").distinct().count()
    borrowers = s.current().count()
    assert generations > borrowers if idle_ms == 1 else generations == borrowers


def test_drops_hold_every_event_once(spark):
    from loanlens.sources.tables import read_table
    rows = streams.dealt(read_table(spark, SF_SMALL, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    assert {r.drop for r in rows.select("drop").distinct().collect()} == set(range(streams.DROPS))


def test_borrowers_share_a_state_and_the_number_of_groups_may_change(spark, tmp_path):
    """One call of Python for a group of borrowers, not one for each; with other groups the sums go on in new generations."""
    df = derive_loans(spark, SF_SMALL).cache()
    s36 = registry.loan_functions()["s36_borrower_progression"]
    for drop, groups in enumerate((4, 4, 3)):
        df.where(F.col("loan_number") % 3 == drop).write.parquet(f"{tmp_path}/landing/d{drop}")
        s = BorrowerStream(spark, f"{tmp_path}/landing", str(tmp_path), partitions=2, groups=groups)
        query = s.start()
        query.awaitTermination()
        if drop < 2:
            assert query.recentProgress[-1].stateOperators[0].numRowsTotal <= groups < s.current().count()
        assert digest(s.progression()) == digest(s36(df.where(F.col("loan_number") % 3 <= drop)))


class State:
    """As GroupState, without a stream."""
    value, timeout, hasTimedOut = None, None, False
    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = self.timeout = None

    def setTimeoutDuration(self, ms):
        assert ms > 0
        self.timeout = self.now + ms

    def getCurrentProcessingTimeMs(self):
        return self.now


def test_an_idle_borrower_loses_the_state_in_a_group_that_is_not_idle():
    state, update = State(), updated(100)

    def call(now, *rows):
        state.now, state.hasTimedOut = now, not rows
        frames = [pd.DataFrame({"member_key": [r[0] for r in rows]} | {c: [1] * len(rows) for c in SUMS}
                               | {c: [r[1] for r in rows] for c in ("low", "high")})]
        return sorted((r.member_key, r.generation, r.version, r.total, None if pd.isna(r.low) else r.low, None if pd.isna(r.high) else r.high)
                      for out in update((0,), iter(frames), state) for r in out.itertuples())

    assert call(1000, ("a", 640), ("b", None), ("a", 600)) == [("a", 1000, 1000, 2, 600, 640), ("b", 1000, 1000, 1, None, None)]
    assert state.timeout == 1100
    assert call(1050, ("b", 700)) == [("b", 1000, 1050, 2, 700, 700)]
    assert state.timeout == 1100                                             # a's
    assert call(1101) == [] and state.exists and state.timeout == 1150       # a has gone, b has not
    assert call(1200, ("a", 620), ("b", 660)) == [("a", 1200, 1200, 1, 620, 620), ("b", 1000, 1200, 3, 660, 700)]
    assert call(1301) == [] and not state.exists


def test_loans_are_derived_once_for_all_drops(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(key):
        seen.add(1)
        return key

    rows = derive_loans(spark, SF_SMALL)
    monkeypatch.setattr(streams, "loans", lambda spark, sf_dir: rows.withColumn("listing_key", F.udf(counted)("listing_key")))
    got = streams.e05_borrower_state(spark, SF_SMALL)
    assert digest(got) == digest(registry.loan_functions()["s36_borrower_progression"](rows))
    assert seen.value == rows.count()
