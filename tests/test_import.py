"""Date texts of several origins, and an import that survives bad records."""
import datetime as dt

import pytest
from pyspark.sql import functions as F

from loanlens.functions.canon import safe_timestamp
from loanlens.functions.dates import host_timestamps, iso_dates
from loanlens.sources.loans import derive_loans
from loanlens.sources.schema import LOAN_COLUMNS, import_counts, import_loans_csv, write_loans_csv

from conftest import SF_SMALL
from helpers import digest

DAY, NOON = dt.datetime(2007, 9, 12), dt.datetime(2007, 9, 12, 12, 5)
TEXTS = {
    "2007-09-12": DAY, "2007-09-12 00:00:00": DAY, "2007-09-12T12:05:00": NOON, "09/12/2007": DAY, "9/12/07": DAY, "09-12-2007": DAY, "9.12.2007 12:05": NOON,
    "Sep 12 2007 12:00AM": DAY, "Sep 12 2007 12:05PM": NOON, "sep 12, 2007": DAY, "September 12, 2007": DAY, "12 Sep 2007": DAY, "12-Sep-2007": DAY,
    "12 September, 2007 12:05": NOON, "20070912": DAY, "20070912 12:05:00": NOON, "2007 Sep 12": DAY, "  09/12/2007  ": DAY, "Sep  12  2007": DAY,
    "09/12/2007 11:05:30.250 PM": dt.datetime(2007, 9, 12, 23, 5, 30, 250_000), "01/02/49": dt.datetime(2049, 1, 2), "01/02/50": dt.datetime(1950, 1, 2),
    "09/12/2007 3 PM": dt.datetime(2007, 9, 12, 15),
    "not-a-date": None, "": None, None: None, "13/12/2007": None, "02/30/2007": None, "Sept 12 2007": None, "Sep 31 2007": None, "20071301": None,
    "09/12/2007 13:00 PM": None, "09/12/2007 25:00": None, "1200-01-01": None, "09/12/2007 5": None, "123456": None}


def test_date_texts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, x string")
    got = {r.x: r.t for r in host_timestamps(df, "x", "t").select("x", F.col("t").cast("timestamp_ntz").alias("t")).collect()}
    assert got == TEXTS


def test_dates_are_rewritten_as_iso(spark):
    df = spark.createDataFrame([(x,) for x in TEXTS if x != "123456"], "x string")        # an ISO cast takes that for a year
    rows = iso_dates(df.withColumn("old", F.col("x")), "x").withColumn("t", safe_timestamp("x").cast("timestamp_ntz")).collect()
    assert {r.old: r.t for r in rows if TEXTS[r.old]} == {x: t for x, t in TEXTS.items() if t}
    assert all(r.x == r.old for r in rows if TEXTS[r.old] is None) and {r.x for r in rows if TEXTS[r.old] == DAY} == {"2007-09-12"}


@pytest.fixture()
def files(spark, tmp_path):
    df = derive_loans(spark, SF_SMALL)
    write_loans_csv(df.coalesce(2), str(tmp_path / "in"))
    head = ",".join(n for n, _ in LOAN_COLUMNS)
    good = next(l for f in (tmp_path / "in").glob("*.csv") for l in f.read_text().splitlines()[1:])
    cells = good.split(",")
    at = {n: i for i, (n, _) in enumerate(LOAN_COLUMNS)}
    bad = [list(cells) for _ in range(3)]
    bad[0][at["loan_number"]] = "12x"
    bad[1][at["loan_original_amount"]], bad[1][at["closed_date"]] = "much", "2001-02-31"
    bad[2] = bad[2][:10]
    (tmp_path / "in" / "bad.csv").write_text("\n".join([head, *(",".join(x) for x in bad), good]) + "\n")
    return df, str(tmp_path / "in"), str(tmp_path / "out"), good


def test_bad_records_are_rejected_and_counted(spark, files):
    df, source, folder, _ = files
    good, rejects = import_loans_csv(spark, source, folder)
    assert good.count() == df.count() + 1 and good.dtypes == df.select([n for n, _ in LOAN_COLUMNS]).dtypes
    rows = rejects.collect()
    reasons = sorted(sorted(x.split(":")[0] for x in r.reasons) for r in rows)
    assert reasons == [["closed_date", "loan_original_amount"], ["fields"], ["loan_number"]]
    assert all(r.file.endswith("bad.csv") and r.record for r in rows) and any("12x" in r.record for r in rows)
    counts = import_counts(spark, folder)
    assert counts == {"good": df.count() + 1, "rejected": 3, "closed_date": 1, "loan_original_amount": 1, "loan_number": 1, "fields": 1}


def test_good_files_have_no_rejects(spark, tmp_path):
    df = derive_loans(spark, SF_SMALL)
    write_loans_csv(df, str(tmp_path / "in"))
    good, rejects = import_loans_csv(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert digest(good) == digest(df) and rejects.count() == 0
    assert import_counts(spark, str(tmp_path / "out")) == {"good": df.count(), "rejected": 0}
