"""Borrower profiles kept up to date by a stream of loan files (keyed state with a timeout).

The state of a borrower holds the sums behind s36's inner measures. Each micro-batch
adds its loans and emits the borrower's new sums; a borrower without loans for
``idle`` loses the state, and a later loan begins a new *generation*. Sums of a
borrower's generations add up, so the timeout bounds the state and changes no result.

The states of the borrowers whose key's hash falls into one of ``groups`` lie together as
an Arrow table and are updated at once, as a call of Python for each borrower took most
of the time. ``groups`` should grow with the borrowers (a group's table is read and
written whole); with another number at a restart borrowers begin new generations.

Loans are summed for each Arrow batch before they are shuffled, so a borrower with a
third of all loans sends one row for each batch to the task that holds their state.
The emitted sums are appended to a Parquet table exactly once; ``current`` reads the
latest of each generation, ``progression`` is s36 over them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loanlens.functions import canon as K
from loanlens.functions import buckets as B
from loanlens.functions.canon import D, dec
from loanlens.plans.tier4 import progression_by_profile
from loanlens.sources.schema import LOAN_SCHEMA
from loanlens.streaming.event_windows import STATE_PARTITIONS, settings, state_settings

#: Added up over loans, batches and generations; ``low`` and ``high`` by minimum and maximum.
SUMS = ("total", "current", "completed", "defaulted", "past_due", "rate_units", "rates", "amount_cents", "amounts")
STATE = ", ".join(f"{c} long" for c in SUMS) + ", low long, high long"


def measured(loans: DataFrame) -> DataFrame:
    """member_key and what a loan adds to its borrower's sums, as whole numbers; loans without a borrower do not count."""
    flag = lambda p: F.coalesce(p, F.lit(False)).cast("long")
    rate, amount = F.col("borrower_rate").cast(D(10, 4)), F.col("loan_original_amount")
    return loans.where(F.col("member_key").isNotNull()).select(
        "member_key", F.lit(1).cast("long").alias("total"), flag(K.is_status(B.STATUS_CURRENT)).alias("current"),
        flag(K.is_status(B.STATUS_COMPLETED)).alias("completed"), flag(K.is_bad()).alias("defaulted"), flag(K.is_past_due()).alias("past_due"),
        F.coalesce((rate * 10_000).cast("long"), F.lit(0).cast("long")).alias("rate_units"), flag(rate.isNotNull()).alias("rates"),
        F.coalesce((amount * 100).cast("long"), F.lit(0).cast("long")).alias("amount_cents"), flag(amount.isNotNull()).alias("amounts"),
        F.col("credit_score_range_lower").cast("long").alias("low"), F.col("credit_score_range_lower").cast("long").alias("high"))


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each borrower of a batch."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by("member_key").aggregate(
            [(c, "sum") for c in SUMS] + [("low", "min"), ("high", "max")])
        names = ["member_key", *(f"{c}_sum" for c in SUMS), "low_min", "high_max"]
        yield from table.select(names).rename_columns(["member_key", *SUMS, "low", "high"]).combine_chunks().to_batches()


def _packed(states: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, states.schema) as out:
        out.write_table(states)
    return sink.getvalue().to_pybytes()


def updated(idle_ms: int):
    """The function of a group's states; it emits a row for each borrower with new loans: generation, version and sums."""
    numbers = ("generation", "version", *SUMS, "low", "high")
    schema = pa.schema([("member_key", pa.string()), *((c, pa.int64()) for c in numbers)])
    summed = [("generation", "min"), ("version", "max"), *((c, "sum") for c in SUMS), ("low", "min"), ("high", "max")]

    def merged(tables: list[pa.Table]) -> pa.Table:
        """A row for each borrower; a new one has no generation yet."""
        out = pa.concat_tables(tables).group_by("member_key").aggregate(summed)
        return out.select(["member_key", *(f"{c}_{how}" for c, how in summed)]).rename_columns(schema.names)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()                # of the batch: the same when it is run again
        states = pa.ipc.open_stream(bytes(state.get[0])).read_all() if state.exists else schema.empty_table()
        came = schema.empty_table()
        for frame in () if state.hasTimedOut else frames:
            came = merged([came, pa.Table.from_pandas(frame.assign(generation=None, version=now)[schema.names], schema, preserve_index=False)])
        states = merged([states, came])
        states = states.set_column(1, "generation", pc.fill_null(states["generation"], now))
        new = states.filter(pc.is_in(states["member_key"], pc.unique(came["member_key"])))
        # a borrower with loans in this batch is not idle, however long there were none
        states = states.filter(pc.greater_equal(states["version"], now - idle_ms))
        if states.num_rows:
            state.update((_packed(states),))
            state.setTimeoutDuration(max(pc.min(states["version"]).as_py() + idle_ms - now, 1))
        else:
            state.remove()
        if new.num_rows:
            yield new.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype(), pa.string(): pd.StringDtype()}.get)
    return update


@dataclass
class BorrowerStream:
    """Profiles of the loans in the Parquet files that land in ``source``; everything it writes lies in ``folder`` (shared)."""
    spark: SparkSession
    source: str
    folder: str
    idle_ms: int = 30 * 24 * 3600 * 1000
    partitions: int = STATE_PARTITIONS
    groups: int = 1024

    def start(self, max_files: int | None = None) -> StreamingQuery:
        reader = self.spark.readStream.schema(LOAN_SCHEMA)
        if max_files:
            reader = reader.option("maxFilesPerTrigger", max_files)
        sums = measured(reader.parquet(f"{self.source}/*")).mapInArrow(_combined, "member_key string, " + STATE)
        group = F.pmod(F.xxhash64("member_key"), F.lit(self.groups))
        profiles = sums.withColumn("group", group).groupBy("group").applyInPandasWithState(
            updated(self.idle_ms), f"member_key string, generation long, version long, {STATE}", "states binary", "append",
            GroupStateTimeout.ProcessingTimeTimeout)
        # without batches that hold no data: a clock's timeout would ask for them for ever; idle states go with the next drop
        with settings(self.spark, state_settings(self.partitions) | {"spark.sql.streaming.noDataMicroBatches.enabled": "false"}):
            return (profiles.writeStream.format("parquet").option("path", f"{self.folder}/profiles")
                    .option("checkpointLocation", f"{self.folder}/checkpoint").outputMode("append").trigger(availableNow=True).start())

    def run(self, max_files: int | None = None) -> None:
        self.start(max_files).awaitTermination()

    def current(self) -> DataFrame:
        """A row for each borrower: the sums over the latest state of each of their generations."""
        rows = self.spark.read.parquet(f"{self.folder}/profiles")
        own = [*SUMS, "low", "high"]
        latest = rows.groupBy("member_key", "generation").agg(F.max_by(F.struct(*own), "version").alias("s"))
        return latest.groupBy("member_key").agg(*(F.sum(f"s.{c}").alias(c) for c in SUMS), F.min("s.low").alias("low"), F.max("s.high").alias("high"))

    def progression(self) -> DataFrame:
        """s36 over the loans so far."""
        average = lambda units, n, scale: K.ratio6(F.try_divide((F.col(units).cast(D(24, 0)) * dec(scale)).cast("double"), F.col(n)))
        return progression_by_profile(self.current().select(
            "member_key", F.col("total").alias("total_loans"), F.col("current").alias("current_loans"), F.col("completed").alias("completed_loans"),
            F.col("defaulted").alias("defaulted_loans"), F.col("past_due").alias("past_due_loans"), K.pct("defaulted", "total").alias("default_rate"),
            F.col("low").cast("int").alias("lowest_credit_score"), F.col("high").cast("int").alias("highest_credit_score"),
            average("rate_units", "rates", "0.0001").alias("avg_borrow_rate"), average("amount_cents", "amounts", "0.01").alias("avg_loan_size")))
