"""Date texts that the reference's host reads and an ISO cast does not.

``TRY_CONVERT(DATETIME, x)`` takes ``09/12/2007`` (month first), ``Sep 12 2007
12:00AM``, ``12-Sep-2007``, ``20070912`` and the like. The analyses read ISO texts
(``canon.safe_timestamp``), so files of such origin are rewritten once, when they come
in: ``iso_dates``. Steps are columns of their own, so the plan computes each once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.functions.canon import D

_CLOCK = r"[ T]+(?=[0-9]{1,2}(?::| ?[AaPp][Mm]))([0-9]{1,2})(?::([0-9]{2})(?::([0-9]{2}(?:[.:][0-9]{1,3})?))?)? ?([AaPp][Mm])?$"
#: Forms of dates, with one blank between their parts: month first, names of months, digits only.
_FORMS = ("M d yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy MMM d", "yyyyMMdd")


def host_timestamps(df: DataFrame, column: str, name: str) -> DataFrame:
    """``df`` with the time that ``column``'s text says, NULL for text that is no date (or before 1753, as there).

    Years of two digits are 1950 to 2049; an hour alone needs AM or PM.
    """
    text = F.regexp_replace(F.trim(column), r"\s+", " ")
    out = df.withColumn("__text", text)
    iso = F.when(~F.col("__text").rlike("^[0-9]{5,}$"), F.col("__text").try_cast("timestamp"))
    out = out.withColumns({"__iso": iso, "__clock": F.regexp_extract("__text", _CLOCK, 0)})
    date = F.regexp_replace(F.regexp_replace(F.regexp_replace("__text", _CLOCK, ""), "[/.,-]", " "), " +", " ")
    out = out.withColumns({"__date": F.when(F.col("__iso").isNull(), date), **{
        f"__c{i}": F.regexp_extract("__clock", _CLOCK, i) for i in range(1, 5)}})
    year = F.regexp_replace(F.regexp_replace("__date", "^((?![0-9]{4} )[^ ]+ [^ ]+) ([0-4][0-9])$", "$1 20$2"), "^((?![0-9]{4} )[^ ]+ [^ ]+) ([5-9][0-9])$", "$1 19$2")
    out = out.withColumns({"__date": year, "__hour": F.col("__c1").try_cast("int"), "__minute": F.coalesce(F.col("__c2").try_cast("int"), F.lit(0)),
                           "__second": F.coalesce(F.replace("__c3", F.lit(":"), F.lit(".")).try_cast(D(8, 3)), F.lit(0).cast(D(8, 3)))})
    hour = F.when(F.col("__c4") == "", F.when((F.col("__hour") < 24) & (F.col("__c2") != ""), F.col("__hour"))).when(
        F.col("__hour").between(1, 12), F.col("__hour") % 12 + F.when(F.upper("__c4") == "PM", 12).otherwise(0))
    out = out.withColumns({"__day": F.coalesce(*(F.try_to_timestamp("__date", F.lit(form)) for form in _FORMS)), "__hour": hour})
    moment = F.unix_micros("__day") + ((F.col("__hour") * 60 + F.col("__minute")) * 60 + F.col("__second")).cast(D(18, 6)) * 1_000_000
    host = F.when(F.col("__clock") == "", F.col("__day")).when((F.col("__minute") < 60) & (F.col("__second") < 60), F.timestamp_micros(moment.cast("long")))
    out = out.withColumn("__found", F.coalesce(F.col("__iso"), host))
    found = F.when(F.col("__found") >= F.lit("1753-01-01").cast("timestamp"), F.col("__found"))
    return out.select(*(c for c in df.columns if c != name), found.alias(name))


def iso_dates(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the date texts of ``columns`` written as ISO; text that is no date stays as it is."""
    order = df.columns
    for c in columns:
        out = host_timestamps(df, c, "__when")
        written = F.regexp_replace(F.date_format("__when", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"(?: 00:00:00)?\.000000$", "")
        df = out.withColumn(c, F.coalesce(written, F.col(c))).select(*order)
    return df
