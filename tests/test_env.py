"""The same answers when a cluster runs with ANSI mode off (division by zero
gives NULL instead of an error, casts are lenient): the bound formulas
guard every division themselves."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF001
from tests.oracle_check import compare, duck

SUBSET = ["count_error", "sum_error", "sum_error_ht", "avg_error", "stratified_error",
          "stratified_bounds", "accuracy_sample_rate", "approx_aggregate_grouped",
          "materialized_agg", "compare_exact_approx", "profile_gini", "exact_median"]


@pytest.fixture()
def ansi_off(spark):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize("name", SUBSET)
def test_same_answers_with_ansi_off(ansi_off, name):
    status, msg, _ = compare(ansi_off, duck(SF001), name, entry.queries()[name],
                             entry.oracle_sql().get(name), SF001)
    assert status == "ok", msg
