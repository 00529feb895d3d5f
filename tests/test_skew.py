"""A third of all loans on one borrower and one state: results stay exact.

The skewed table is written once; Spark runs the analyses on it and DuckDB
runs the same oracle SQL bodies on the same files.
"""
import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

from loanlens.plans import registry
from loanlens.plans.sqlkit import section_body
from verify import compare

KEYS = ["s04_status_summary", "s16_repeat_borrower_basic", "s22_score_employment",
        "s23_repeat_borrower_history", "s26_geo_concentration", "s31_geo_risk",
        "s34_occupation_risk", "s36_borrower_progression", "s37_composite_score"]


@pytest.fixture(scope="module")
def skewed(spark, loans_mid):
    hot = (F.col("loan_number") % 3) == 0
    df = (loans_mid
          .withColumn("member_key", F.when(hot, F.lit("HOT-BORROWER")).otherwise(F.col("member_key")))
          .withColumn("borrower_state", F.when(hot, F.lit("HOT-STATE")).otherwise(F.col("borrower_state"))))
    path = tempfile.mkdtemp(prefix="loanlens-skew-") + "/loans"
    df.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW loan AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return spark.read.parquet(path), con


@pytest.mark.parametrize("name", KEYS)
def test_hot_borrower_and_state(skewed, name):
    df, con = skewed
    rep = compare(registry.loan_functions()[name](df),
                  section_body(registry.oracle_sql()[name]), con)
    assert rep["ok"], rep
