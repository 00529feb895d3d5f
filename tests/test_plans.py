"""Physical-plan properties that matter at scale."""
import tempfile

import pytest

from loanlens.plans import registry
from loanlens.sources.loans import derive_loans, write_loans

from conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    d = tempfile.mkdtemp(prefix="loanlens-plan-")
    write_loans(derive_loans(spark, SF_SMALL), d + "/loans")
    return spark.read.parquet(d + "/loans")


@pytest.mark.parametrize("name", sorted(registry.loan_functions()))
def test_no_python_udf_and_single_scan(spark, stored, name):
    df = registry.loan_functions()[name](stored)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    phys = _plan(df)
    for node in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF"):
        assert node not in phys
    # every analysis reads the loan table exactly once (shares of unfiltered
    # totals come from the same aggregation, scenarios from one row)
    assert plan.count("Relation [") == 1, plan


def test_filters_and_columns_reach_the_scan(spark, stored):
    df = registry.loan_functions()["s21_yield_matrix"](stored)
    phys = _plan(df)
    scan = [ln for ln in phys.splitlines() if "FileScan parquet" in ln][0]
    pushed = scan.split("PushedFilters: [")[1].split("]")[0]
    for f in ("IsNotNull(risk_rating)", "IsNotNull(term)", "EqualTo(term,36)"):
        assert f in pushed
    assert "loan_status" not in scan and "member_key" not in scan


def test_unpartitioned_windows_sit_above_an_aggregate(spark, stored):
    for name in ("s26_geo_concentration", "s31_geo_risk", "s38_scorecard", "s28_delinquency_history"):
        plan = registry.loan_functions()[name](stored)._jdf.queryExecution().optimizedPlan().toString()
        lines = plan.splitlines()
        win = [i for i, ln in enumerate(lines) if "Window [" in ln]
        agg = [i for i, ln in enumerate(lines) if "Aggregate [" in ln]
        assert win and agg and max(win) < max(agg), name   # windows printed above (after) the aggregate


def test_loan_view_has_no_user_repartition(spark):
    """User repartitions are exempt from AQE skew splitting; the build has none."""
    plan = derive_loans(spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan


@pytest.mark.parametrize("name", ["s16_repeat_borrower_basic", "s23_repeat_borrower_history",
                                  "s36_borrower_progression", "s04_status_summary",
                                  "s22_score_employment", "s34_occupation_risk"])
def test_hot_keys_are_combined_map_side(spark, stored, name):
    """A borrower (or status) holding a third of all rows must not reach one
    reducer as raw rows: every shuffle is fed by a partial aggregate."""
    phys = registry.loan_functions()[name](stored)._jdf.queryExecution().executedPlan().toString()
    lines = phys.splitlines()
    for i, ln in enumerate(lines):
        if "Exchange hashpartitioning" in ln:
            below = lines[i + 1].strip()
            assert "HashAggregate" in below, (name, ln, below)


def test_loan_build_plan_at_scale_shape(spark):
    """With automatic broadcasts off (as for 100 TB inputs) the build shuffles
    exactly: orders and line aggregate on the order key (co-partitioned, no
    exchange between the aggregate and the join), then both sides of the
    customer join on the customer key, and both sides of the small nation
    join, which AQE broadcasts from its measured size. Building it runs no job."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",
                                          "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    try:
        for k in old:
            spark.conf.set(k, "-1")
        df = derive_loans(spark, SF_SMALL)
        phys = df._jdf.queryExecution().executedPlan().toString()
        ex = [ln.strip() for ln in phys.splitlines() if "Exchange hashpartitioning" in ln]
        keys = sorted(ln.split("hashpartitioning(")[1].split("#")[0] for ln in ex)
        assert keys == ["c_custkey", "c_nationkey", "l_orderkey", "n_nationkey", "o_custkey", "o_orderkey"], ex
        assert phys.count("SortMergeJoin") == 3 and "BroadcastExchange" not in phys
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)



@pytest.mark.parametrize("name", sorted(registry.loan_functions()))
def test_final_aggregate_is_parallel(spark, stored, name):
    """The one-task sort of a result reads an exchange above the last aggregate."""
    phys = _plan(registry.loan_functions()[name](stored))
    assert "Coalesce 1" not in phys
    lines = [ln.strip(" +-:") for ln in phys.splitlines()]
    aggregates = [i for i, ln in enumerate(lines) if "HashAggregate(" in ln or "SortAggregate(" in ln]
    if aggregates and "keys=[]" not in lines[aggregates[0]] and any("RoundRobin" in ln or ln.startswith("Exchange SinglePartition") for ln in lines):
        assert any("Exchange" in ln for ln in lines[:aggregates[0]]), phys


def test_building_a_frame_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "build")
    try:
        # reading a Parquet footer for the schema is a job of the reader
        before = len(tracker.getJobIdsForGroup("build"))
        for t in ("orders", "customer", "nation", "lineitem"):
            spark.read.parquet(f"{SF_SMALL}/{t}.parquet")
        footers = len(tracker.getJobIdsForGroup("build")) - before
        derive_loans(spark, SF_SMALL)
        assert len(tracker.getJobIdsForGroup("build")) - before == 2 * footers
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
