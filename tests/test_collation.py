"""Under the database collation every analysis gives over text of several spellings what it gives over one."""
import pytest
from pyspark.sql import functions as F

from loanlens.functions.collation import CASE_AND_BLANKS, collated, grouped, is_collated, plain
from loanlens.plans import registry
from loanlens.plans.extended import respelled

from conftest import SF_SMALL
from helpers import digest


@pytest.fixture(scope="module")
def one_spelling(spark):
    from loanlens.sources.loans import derive_loans
    df = derive_loans(spark, SF_SMALL).cache()
    df.count()
    return df


def folded(df):
    """A result with its text folded, so that spellings of a label do not count."""
    return df.select(*(F.lower(F.rtrim(F.collate(F.col(f.name), "UTF8_BINARY"))).alias(f.name) if "string" in f.dataType.simpleString() else F.col(f.name)
                       for f in df.schema.fields))


@pytest.mark.parametrize("name", sorted(registry.loan_functions()))
def test_analyses_under_the_collation(spark, one_spelling, name):
    fn = registry.loan_functions()[name]
    several = collated(respelled(one_spelling), CASE_AND_BLANKS)
    assert digest(folded(fn(several))) == digest(folded(fn(one_spelling)))


def test_predicates_follow_the_column(spark):
    df = collated(spark.createDataFrame([("Completed",), ("completed  ",), ("COMPLETED",), ("x",), (None,), ("",), ("  ",)], "s string"))
    assert df.where(F.col("s") == "completed").count() == 3 and df.where(F.col("s").isin("COMPLETED ", "X")).count() == 4
    assert df.where(F.col("s").startswith("COMP")).count() == 3 and df.where(F.col("s") == "").count() == 2
    assert df.select(F.count_distinct("s")).first()[0] == 3


def test_the_smallest_spelling_stands_for_a_group(spark):
    df = spark.createDataFrame([("b ", 1), ("B", 2), ("b", 4), (None, 8), ("a", 16)], "s string, v int")
    for parts in (1, 3, 5):
        out = grouped(collated(df).repartition(parts), "s", (F.col("v") > 100).alias("big")).agg(F.sum("v").alias("v"))
        assert {(r.s, r.big, r.v) for r in out.collect()} == {("B", False, 7), (None, False, 8), ("a", False, 16)}
        assert not is_collated(out.schema["s"].dataType)
    assert out.columns == ["s", "big", "v"]


def test_without_a_collation_nothing_changes(spark):
    df = spark.createDataFrame([("b ", 1), ("B", 2)], "s string, v int")
    assert collated(df, None) is df and plain(collated(df)).schema == df.schema
    assert grouped(df, "s").agg(F.count("v")).count() == 2
    assert [f.name for f in collated(df, columns=[]).schema.fields if is_collated(f.dataType)] == []


def test_groups_are_combined_before_the_shuffle(spark):
    plan = grouped(collated(spark.range(10).selectExpr("string(id % 2) AS s")), "s").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
