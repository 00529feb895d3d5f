"""Same results for 1 / 4 / 13 shuffle partitions and after reshuffling the input."""
import pytest
from pyspark.sql import functions as F

from loanlens.plans import registry

from helpers import digest

KEYS = ["s04_status_summary", "s16_repeat_borrower_basic", "s23_repeat_borrower_history",
        "s26_geo_concentration", "s31_geo_risk", "s34_occupation_risk", "s36_borrower_progression",
        "s38_scorecard"]




@pytest.mark.parametrize("name", KEYS)
def test_partitioning_and_row_order_do_not_change_results(spark, loans_mid, name):
    fn = registry.loan_functions()[name]
    ref = digest(fn(loans_mid))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            assert digest(fn(loans_mid)) == ref
        shuffled = loans_mid.repartition(7).orderBy(F.rand(seed=3))
        assert digest(fn(shuffled)) == ref
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
