"""Loan table: DataFrame derivation equals the fixture SQL; CSV / Parquet round trips."""
import tempfile

import pytest
from pyspark.sql import functions as F

from loanlens.plans import registry
from loanlens.plans.sqlkit import LOAN_CTE
from loanlens.sources.loans import (LOANS_PATH_CONF, LOANS_SOURCE_CONF, derive_loans, loans,
                                    materialize_loans)
from loanlens.sources.schema import LOAN_COLUMNS, LOAN_SCHEMA, read_loans_csv, write_loans_csv
from loanlens.sources.tables import read_table

from helpers import digest
from conftest import SF_SMALL




def test_schema_is_the_derived_schema(spark):
    got = derive_loans(spark, SF_SMALL).schema
    assert [(f.name, f.dataType) for f in got.fields] == \
        [(f.name, f.dataType) for f in LOAN_SCHEMA.fields]


def test_dataframe_view_equals_fixture_sql_in_spark(spark):
    tables = {t: read_table(spark, SF_SMALL, t) for t in ("orders", "customer", "nation", "lineitem")}
    text = LOAN_CTE
    for t in tables:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    sql_df = spark.sql(text + " SELECT * FROM loan", **tables)
    assert digest(sql_df) == digest(derive_loans(spark, SF_SMALL))


def test_csv_round_trip_keeps_nulls_and_empty_strings(spark):
    src = derive_loans(spark, SF_SMALL)
    d = tempfile.mkdtemp(prefix="loanlens-csv-")
    write_loans_csv(src, d + "/loans_csv")
    back = read_loans_csv(spark, d + "/loans_csv")
    assert digest(back) == digest(src)
    fns = registry.loan_functions()
    for k in ("s01_post2009_snapshot", "s06_yearly_trend", "s19_vintage_quarter"):
        assert digest(fns[k](back)) == digest(fns[k](src))


@pytest.fixture()
def own_tables(tmp_path):
    """A copy of the small tables that a test may change."""
    import shutil
    for t in ("orders", "customer", "nation", "lineitem"):
        shutil.copy(f"{SF_SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    return str(tmp_path)


def test_stored_table_is_refused_when_its_source_changed(spark, own_tables):
    import os
    try:
        materialize_loans(spark, own_tables)
        assert loans(spark, own_tables).count() == derive_loans(spark, SF_SMALL).count()
        os.utime(f"{own_tables}/orders.parquet", (1, 1))
        with pytest.raises(ValueError, match="have changed"):
            loans(spark, own_tables)
    finally:
        spark.conf.unset(LOANS_PATH_CONF)
        spark.conf.unset(LOANS_SOURCE_CONF)


def test_a_stored_path_without_its_source_is_not_used(spark):
    spark.conf.set(LOANS_PATH_CONF, "/nonexistent")
    try:
        assert "l_orderkey" in loans(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset(LOANS_PATH_CONF)


class _Context:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None

    def getConf(self):
        return {}


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_checkpoint_folder(master):
    from types import SimpleNamespace

    from loanlens.session import checkpoint_dir
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(sparkContext=_Context(master)))


def test_csv_columns_are_bound_by_name(spark, tmp_path):
    src = derive_loans(spark, SF_SMALL)
    names = [n for n, _ in LOAN_COLUMNS]
    src.select(*reversed(names), F.lit("x").alias("extra")).write.options(header="true").csv(str(tmp_path / "shuffled"))
    assert digest(read_loans_csv(spark, str(tmp_path / "shuffled"))) == digest(src)
    src.drop("lender_yield").write.options(header="true").csv(str(tmp_path / "short"))
    with pytest.raises(ValueError, match="lender_yield"):
        read_loans_csv(spark, str(tmp_path / "short"))


def test_csv_files_of_another_origin_are_mapped(spark, tmp_path):
    src = derive_loans(spark, SF_SMALL)
    heads = {f"Head {i}": n for i, (n, _) in enumerate(LOAN_COLUMNS) if n != "loan_origination_date"}
    src.select(*(F.col(n).alias(h) for h, n in heads.items())).write.options(header="true").csv(str(tmp_path / "foreign"))
    back = read_loans_csv(spark, str(tmp_path / "foreign"), heads)
    # one date text fills both columns; text that is no date gives no date
    want = src.withColumn("loan_origination_date", F.col("loan_origination_raw").try_cast("date"))
    assert digest(back) == digest(want)
    assert back.where("loan_origination_raw = 'not-a-date' AND loan_origination_date IS NULL").count() > 0
    with pytest.raises(ValueError, match="not mapped"):
        read_loans_csv(spark, str(tmp_path / "foreign"), {"Head 0": "listing_key"})


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json"])
def test_export_from_the_command_line(spark, tmp_path, fmt, monkeypatch):
    import loanlens.session
    from loanlens.__main__ import main
    monkeypatch.setattr(loanlens.session, "get_session", lambda *a, **k: spark)
    out = str(tmp_path / fmt)
    assert main(["run", "s31_geo_risk", "--sf-dir", SF_SMALL, "--out", out, "--format", fmt]) == 0
    want = registry.queries()["s31_geo_risk"](spark, SF_SMALL)
    reader = spark.read.schema(want.schema)
    back = reader.option("header", "true").csv(out) if fmt == "csv" else reader.format(fmt).load(out)
    assert digest(back) == digest(want)


def test_materialized_copy_only_serves_its_own_scale(spark):
    path = materialize_loans(spark, SF_SMALL)
    try:
        assert spark.conf.get(LOANS_PATH_CONF) == path
        plan = loans(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan
        other = loans(spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" in other
    finally:
        spark.conf.unset(LOANS_PATH_CONF)
        spark.conf.unset(LOANS_SOURCE_CONF)


def test_loan_table_equals_duckdb_fixture_sql(spark, duck_mid):
    """All 48 columns, row by row, against DuckDB running the FIXTURES.md text."""
    from verify import compare
    from conftest import SF_MID
    rep = compare(derive_loans(spark, SF_MID), LOAN_CTE + " SELECT * FROM loan", duck_mid)
    assert rep["ok"], rep



def test_auto_materialize_stores_once_per_scale(spark):
    from loanlens.sources.loans import AUTO_MATERIALIZE_CONF
    spark.conf.set(AUTO_MATERIALIZE_CONF, "true")
    try:
        first = loans(spark, SF_SMALL)
        path = spark.conf.get(LOANS_PATH_CONF)
        second = loans(spark, SF_SMALL)
        assert spark.conf.get(LOANS_PATH_CONF) == path
        assert "l_orderkey" not in second._jdf.queryExecution().optimizedPlan().toString()
        assert first.count() == second.count() == derive_loans(spark, SF_SMALL).count()
    finally:
        for k in (AUTO_MATERIALIZE_CONF, LOANS_PATH_CONF, LOANS_SOURCE_CONF):
            spark.conf.unset(k)
