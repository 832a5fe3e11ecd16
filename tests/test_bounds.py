"""Error-bound and accuracy-map formulas against the published vectors."""

import math

import pytest

from roughcut.functions import bounds
from roughcut.functions.hashing import threshold


def _one(spark, cols: dict):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first().asDict()


@pytest.mark.parametrize("n,total,err,lo,hi", [
    (4_910_460, 49_104_600, 0.03, 49_092_238, 49_116_961),
    (4_905_546, 49_055_460, 0.03, 49_043_105, 49_067_814),
    (4_905_916, 49_059_160, 0.03, 49_046_804, 49_071_515),
    (98_879, 988_790, 0.18, 987_035, 990_544),
    (946, 9_460, 1.81, 9_288, 9_631),
    (100, 1_000, 5.58, 944, 1_055),
])
def test_count_bound_vectors(spark, n, total, err, lo, hi):
    r = _one(spark, bounds.count_bound(n, 0.1))
    assert (r["estimated_total"], r["error_pct"], r["ci_low"], r["ci_high"]) == (total, err, lo, hi)


def test_count_bound_empty_is_null(spark):
    r = _one(spark, bounds.count_bound(0, 0.1))
    assert all(v is None for v in r.values())


def test_ht_bound_is_wider(spark):
    p = _one(spark, bounds.count_bound(946, 0.1))["error_pct"]
    h = _one(spark, bounds.count_bound(946, 0.1, method="ht"))["error_pct"]
    assert h == pytest.approx(p / math.sqrt(0.1), rel=0.01)


def test_sum_bound_vector(spark):
    r = _one(spark, bounds.sum_bound(50000.0, 28.87, 1000, 10000))
    assert r == {"estimated_total": 500000.0, "error_pct": 3.4,
                 "ci_low": 483023.59, "ci_high": 516976.41}


def test_sum_bound_single_row_is_null(spark):
    r = _one(spark, bounds.sum_bound(5.0, "CAST(NULL AS DOUBLE)", 1, 1))
    assert r["error_pct"] is None and r["ci_low"] is None


def test_avg_bound_vector(spark):
    r = _one(spark, bounds.avg_bound(28.87, 1000, 10000))
    assert r == {"standard_error": 0.8661, "margin": 1.6976}


@pytest.mark.parametrize("acc,mean,sd,n,rate", [
    (0.95, 500.0, 288.68, 10_000_000, 0.05),
    (0.99, 49.630657, 49.102351, 10_000, 0.5),
    (0.99, 49.63, 49.1, 60_000, 0.15666620912),
    (0.95, 0.0, 1.0, 1000, 0.1),
])
def test_accuracy_to_rate(spark, acc, mean, sd, n, rate):
    col = _one(spark, {"r": bounds.accuracy_to_rate(acc, mean, sd, n)})["r"]
    assert col == pytest.approx(rate, rel=1e-9)
    assert bounds.accuracy_to_rate_py(acc, mean, sd, n) == pytest.approx(rate, rel=1e-9)


@pytest.mark.parametrize("N,n,err", [(9000, 87, 2.06), (980, 8, 6.24), (20, 1, 42.72),
                                     (20, 2, 41.58), (9000, 946, 1.95)])
def test_stratum_error(spark, N, n, err):
    assert _one(spark, {"e": bounds.stratum_error_pct(n, N)})["e"] == err


@pytest.mark.parametrize("acc,p,tier", [(0.85, 10, 0.01), (0.90, 12, 0.10), (0.95, 14, 0.20),
                                        (0.99, 16, 0.20)])
def test_accuracy_maps(spark, acc, p, tier):
    r = _one(spark, {"p": bounds.accuracy_to_hll_precision(acc), "t": bounds.tier_for_accuracy(acc)})
    assert r == {"p": p, "t": tier}
    assert bounds.accuracy_to_hll_precision_py(acc) == p
    assert bounds.tier_for_accuracy_py(acc) == tier


@pytest.mark.parametrize("p,pct", [(10, 3.25), (12, 1.625), (14, 0.8125), (16, 0.40625)])
def test_hll_error(spark, p, pct):
    assert _one(spark, {"e": bounds.hll_error_pct(p)})["e"] == pytest.approx(pct)


def test_thresholds():
    assert threshold(0.01) == 11529215046068470
    assert threshold(0.1) == 115292150460684704
    assert threshold(0.2) == 230584300921369408
    assert threshold(1.0) == 1 << 60
