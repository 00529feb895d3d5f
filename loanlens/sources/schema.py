"""Explicit schema of the loan table and its file readers / writers.

The reference loads a CSV through an import wizard that picks the types.
Here the schema is fixed and never inferred: a CSV export of the loan
table (header, ISO dates, empty field = NULL, quoted empty string = '')
reads back to exactly the same DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MONEY = T.DecimalType(15, 2)
_RATE = T.DecimalType(10, 4)
_S, _I, _L, _DT = T.StringType(), T.IntegerType(), T.LongType(), T.DateType()

LOAN_COLUMNS: list[tuple[str, T.DataType]] = [
    ("listing_key", _S), ("loan_key", _S), ("loan_number", _L), ("member_key", _S),
    ("loan_status", _S), ("loan_origination_date", _DT), ("loan_origination_raw", _S),
    ("closed_date", _DT), ("loan_original_amount", _MONEY), ("term", _I),
    ("monthly_loan_payment", _MONEY), ("borrower_apr", _RATE), ("borrower_rate", _RATE),
    ("lender_yield", _RATE), ("estimated_effective_yield", _RATE), ("estimated_loss", _RATE),
    ("estimated_return", _RATE), ("risk_rating", _S), ("platform_score", _I),
    ("investors", _I), ("percent_funded", T.DecimalType(5, 4)),
    ("investment_from_friends_count", _I), ("borrower_state", _S), ("occupation", _S),
    ("employment_status", _S), ("employment_status_duration", _I),
    ("is_borrower_homeowner", _S), ("income_range", _S), ("stated_monthly_income", _MONEY),
    ("debt_to_income_ratio", _RATE), ("credit_score_range_lower", _I),
    ("credit_score_range_upper", _I), ("open_credit_lines", _I), ("current_delinquencies", _I),
    ("delinquencies_last_7_years", _I), ("public_records_last_10_years", _I),
    ("loan_current_days_delinquent", _I), ("bankcard_utilization", _RATE),
    ("revolving_credit_balance", _MONEY), ("available_bankcard_credit", _MONEY),
    ("lp_customer_payments", _MONEY), ("lp_customer_principal_payments", _MONEY),
    ("lp_interest_and_fees", _MONEY), ("lp_service_fees", _MONEY),
    ("lp_collection_fees", _MONEY), ("lp_gross_principal_loss", _MONEY),
    ("lp_net_principal_loss", _MONEY), ("lp_non_principal_recovery_payments", _MONEY),
]

LOAN_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in LOAN_COLUMNS])

# a blank field is NULL; a quoted empty field ("") is the empty string: the
# reader maps blanks to a sentinel that then reads as NULL. Columns are bound
# by the header's names: a file whose header differs from the others' fails.
CSV_OPTIONS = {"header": "true", "mode": "FAILFAST", "enforceSchema": "false",
               "nullValue": "\\N", "emptyValue": ""}

_DATES = ("loan_origination_date", "loan_origination_raw")


def by_name(df: DataFrame, mapping: dict[str, str] | None = None, lenient: bool = False) -> DataFrame:
    """The 48 loan columns from text columns, bound by name and cast (a malformed value fails).

    ``mapping``: file header -> loan column, for files of other origin; without
    it the headers are the loan columns' names. Other columns are ignored, a
    missing one fails. One mapped date text fills both date columns: the raw
    text as it is, the date NULL where the text is no date. ``lenient``: a malformed
    value is NULL and named in ``reasons``; the other columns are kept beside.
    """
    source = {col: head for head, col in (mapping or {n: n for n, _ in LOAN_COLUMNS}).items()}
    given = [d for d in _DATES if d in source]
    if mapping and len(given) == 1:
        source |= {d: source[given[0]] for d in _DATES}
    missing = [f"{n} ({source.get(n, 'not mapped')})" for n, _ in LOAN_COLUMNS if source.get(n) not in df.columns]
    if missing:
        raise ValueError("the file lacks: " + ", ".join(missing))

    def typed(name: str, kind: T.DataType):
        x = F.col("`" + source[name].replace("`", "``") + "`")
        if mapping and len(given) == 1 and name == "loan_origination_date":
            return x.try_cast("timestamp").cast(kind)
        return x.try_cast(kind) if lenient else x.cast(kind)
    columns = [typed(n, t).alias(n) for n, t in LOAN_COLUMNS]
    if not lenient:
        return df.select(*columns)
    free = mapping and len(given) == 1                          # its date may be any text
    reasons = []
    for n, t in LOAN_COLUMNS:
        if not isinstance(t, T.StringType) and not (free and n == "loan_origination_date"):
            x = F.col("`" + source[n].replace("`", "``") + "`")
            reasons.append(F.when(x.isNotNull() & x.try_cast(t).isNull(), F.concat(F.lit(f"{n}: "), x)))
    held = [c for c in df.columns if c.startswith("__")]
    return df.select(*columns, *held, F.filter(F.array(*reasons), lambda r: r.isNotNull()).alias("reasons"))


def read_loans_csv(spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Read CSV files with a header by column name, see ``by_name``. No inference, no
    silent dropping: a malformed record or value fails the job."""
    return by_name(spark.read.options(**CSV_OPTIONS).csv(path), mapping)


def checked(df: DataFrame, mapping: dict[str, str] | None = None, malformed: str | None = None) -> DataFrame:
    """The 48 loan columns as ``by_name`` gives them, with ``reasons``: the values that do not fit, empty for a good record.

    A value that does not fit is NULL in its column. ``malformed``: a column that holds records that could not be split into fields.
    """
    names = by_name(df, mapping, lenient=True)
    return names if malformed is None else names.withColumn("reasons", F.when(F.col(malformed).isNotNull(), F.array(F.lit("fields"))).otherwise(F.col("reasons")))


def import_loans_csv(spark: SparkSession, path: str, folder: str, mapping: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Reads CSV files into ``folder`` (shared): (good records as loans, rejected records with their ``file``, ``record`` and ``reasons``).

    One pass over the files; a bad record does not end it, and none is dropped. ``import_counts`` counts both.
    """
    options = CSV_OPTIONS | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _MALFORMED}
    head = spark.read.options(**CSV_OPTIONS).csv(path).columns
    text = T.StructType([T.StructField(n, _S) for n in [*head, _MALFORMED]])
    raw = spark.read.schema(text).options(**options).csv(path).select("*", F.col("_metadata.file_path").alias("__file"))
    rows = checked(raw.withColumn("__record", F.to_json(F.struct(*head))), mapping, _MALFORMED)
    rows = rows.withColumn("rejected", F.size("reasons") > 0)
    kept = F.when(F.col("rejected"), F.coalesce(F.col(_MALFORMED), F.col("__record")))
    rows.select(*(n for n, _ in LOAN_COLUMNS), F.when(F.col("rejected"), F.col("__file")).alias("file"), kept.alias("record"), "reasons", "rejected") \
        .write.partitionBy("rejected").parquet(folder)
    stored = spark.read.schema(_stored_schema()).parquet(folder)
    return (stored.where(~F.col("rejected")).select(*(n for n, _ in LOAN_COLUMNS)),
            stored.where("rejected").select("file", "record", "reasons"))


_MALFORMED = "__malformed"


def _stored_schema() -> T.StructType:
    more = [T.StructField("file", _S), T.StructField("record", _S), T.StructField("reasons", T.ArrayType(_S)), T.StructField("rejected", T.BooleanType())]
    return T.StructType([*LOAN_SCHEMA.fields, *more])


def import_counts(spark: SparkSession, folder: str) -> dict[str, int]:
    """Records of an import: good and rejected ones, and by reason (the column that did not fit)."""
    stored = spark.read.schema(_stored_schema()).parquet(folder)
    rows = stored.groupBy("rejected").count().collect()
    out = {"good": 0, "rejected": 0} | {"rejected" if r.rejected else "good": r["count"] for r in rows}
    by_reason = (stored.where("rejected").select(F.explode("reasons").alias("r"))
                 .groupBy(F.substring_index("r", ":", 1).alias("column")).count().collect())             # 49 rows at most
    return out | {r.column: r["count"] for r in by_reason}


def write_loans_csv(df: DataFrame, path: str) -> str:
    df.select([n for n, _ in LOAN_COLUMNS]).write.mode("overwrite") \
        .options(header="true", dateFormat="yyyy-MM-dd").csv(path)
    return path


def read_loans_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOAN_SCHEMA).parquet(path)


def conform(df: DataFrame) -> DataFrame:
    """Select and cast the 48 loan columns in schema order (for foreign inputs)."""
    return df.select([df[n].cast(t).alias(n) for n, t in LOAN_COLUMNS])
