"""The measured facts of FIXTURES.md §2 for the derived `sales` table."""

import pytest
from pyspark.sql import functions as F

from roughcut.functions.hashing import threshold
from roughcut.operators import profile as prof
from roughcut.sources.tables import sales_with_hash

FACTS = {
    "/root/testdata/sf0.01": dict(rows=10_000, split={"US": 9_000, "UK": 980, "Antarctica": 20},
                                  users=150, sum_amount="496306.57", over_50=3_665,
                                  tenth={"US": 946, "UK": 100}, bin_gini=0.7934),
    "/root/testdata/sf0.1": dict(rows=100_000, split={"US": 90_000, "UK": 9_800, "Antarctica": 200},
                                 users=1_500, sum_amount="4986830.83", over_50=36_763,
                                 tenth={"US": 9_236, "UK": 980, "Antarctica": 14}, bin_gini=0.8175,
                                 max_amount="560.21"),
}


@pytest.mark.parametrize("sf_dir", list(FACTS))
def test_sales_fixture_facts(spark, sf_dir):
    f = FACTS[sf_dir]
    s = sales_with_hash(spark, sf_dir)
    r = s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("u"),
              F.sum("amount").alias("s"), F.max("amount").alias("mx"),
              F.count_if(F.col("amount") > 50).alias("o")).first()
    assert (r["n"], r["u"], str(r["s"]), r["o"]) == (f["rows"], f["users"], f["sum_amount"], f["over_50"])
    if "max_amount" in f:
        assert str(r["mx"]) == f["max_amount"]
    assert {x["region"]: x["count"] for x in s.groupBy("region").count().collect()} == f["split"]
    tenth = s.filter(F.col("h") < threshold(0.1)).groupBy("region").count().collect()
    assert {x["region"]: x["count"] for x in tenth} == f["tenth"]
    assert round(prof.histogram_gini(s, "amount").first()["gini"], 4) == f["bin_gini"]
