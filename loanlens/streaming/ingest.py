"""Continuous import of loan records into the stored loan table.

The reference imports one CSV by hand and then runs its analyses. Here new
loan-record files (CSV or Parquet, fixed schema) landing in a folder are
appended to the stored loan table by a Structured Streaming query with a
file sink: the checkpoint (in the cluster's shared checkpoint folder) makes
the append exactly-once and lets a restarted or failed job resume where it
stopped. The analyses then run on that table:
``registry.loan_functions()[key](spark.read.parquet(table_path))``.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from loanlens.session import checkpoint_dir
from loanlens.sources.schema import CSV_OPTIONS, LOAN_COLUMNS, LOAN_SCHEMA, by_name


def loan_file_stream(spark: SparkSession, source_dir: str, fmt: str = "csv",
                     max_files_per_trigger: int | None = None, mapping: dict[str, str] | None = None):
    """Streaming DataFrame over loan-record files (no schema inference).

    CSV columns are bound by name: the header that the folder's files have when
    the stream starts (the loan columns in order if there is none yet); a file
    with another header fails the query.
    """
    r = spark.readStream
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    if fmt == "csv":
        head = spark.read.options(**CSV_OPTIONS).option("pathGlobFilter", "*.csv").csv(source_dir).columns
        head = head or list(mapping or dict(LOAN_COLUMNS))
        text = T.StructType([T.StructField(n, T.StringType()) for n in head])
        return by_name(r.schema(text).options(**CSV_OPTIONS).csv(source_dir), mapping)
    if fmt == "parquet":
        return r.schema(LOAN_SCHEMA).parquet(source_dir)
    raise ValueError(fmt)


def ingest(spark: SparkSession, source_dir: str, table_path: str, fmt: str = "csv",
           query_name: str = "loan_ingest", available_now: bool = True,
           checkpoint_location: str | None = None, mapping: dict[str, str] | None = None) -> StreamingQuery:
    """Start the append stream; ``available_now`` processes what is there and stops."""
    ckpt = checkpoint_location or os.path.join(checkpoint_dir(spark), "streams", query_name)
    w = (loan_file_stream(spark, source_dir, fmt, mapping=mapping)
         .select([n for n, _ in LOAN_COLUMNS])
         .writeStream.format("parquet")
         .option("path", table_path)
         .option("checkpointLocation", ckpt)
         .outputMode("append")
         .queryName(query_name))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
