"""The registered queries: one Spark callable per inventory row.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame over the
whole given tables. Column names match the SQL twins in
:mod:`roughcut.oracle`; doubles are rounded to 6 decimals on both sides
(integer counts and 2-decimal bounds are compared as they are).

Queries marked *tolerance* return the exact answer plus booleans computed
from the approximate one (sketch values are engine-specific, so only the
guarantee is comparable).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roughcut.functions import bounds
from roughcut.functions.frames import join_on_groups, with_scalars
from roughcut.functions.hashing import threshold
from roughcut.operators import profile as prof
from roughcut.operators import sampling, sketches, stratified
from roughcut.operators.blocks import block_aggregate, block_sample
from roughcut.operators.bootstrap import Ratio, bootstrap_aggregate
from roughcut.operators.distinct_sets import distinct_in, is_in, value_sketches
from roughcut.operators.allocation import allocate, allocated_aggregate, allocated_sample
from roughcut.operators.heavy import heavy_hitters, skew_bounds
from roughcut.operators.outliers import is_outlier, outlier_cut
from roughcut.operators.priority import priority_aggregate, priority_sample
from roughcut.operators.quantile import exact_quantiles, exact_quantiles_grouped
from roughcut.operators.samples import DEFAULT_TIERS, SampleStore
from roughcut.operators.summaries import file_summaries, range_aggregate
from roughcut.operators.upkeep import append_files, build_from_files
from roughcut.plans.aggregate import approx_aggregate, exact_aggregate
from roughcut.plans.compare import (ACCURACY_LEVELS, accuracy_sweep, compare_exact_approx,
                                    compare_strategies)
from roughcut.session import shared_dir
from roughcut.sources.tables import (derive_sales, load_sales, read_table, register_tables,
                                     sales_with_hash, write_parquet)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEY_RSD = (0.04, 0.01, 0.005)
STRAT_RATE = 0.01  # stratified queries use 1 % so the guarantee matters (Antarctica)
UNIFORM_RATE = 0.10
HLL_PRECISIONS = (10, 12, 14, 16)
PERCENTILES = (0.25, 0.5, 0.75, 0.95, 0.99, 0.999)
RANK_EPS = 1.5 / sketches.DEFAULT_PCT_ACCURACY  # 1.5 times the promised rank error
KLL_EPS = 0.05  # rank tolerance for KLL k=200 (about 3x its normalised rank error)
KLL_K = 200
NARROWED = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def _sales(spark, d):
    return sales_with_hash(spark, d)


_WRITTEN: dict[tuple, str] = {}  # (application, table folder, name) -> path already written


def _once(spark: SparkSession, d: str, name: str, write: Callable[[str], object]) -> str:
    """Path of a data set that is written by the first call of a session and reused by later ones."""
    at = (spark.sparkContext.applicationId, d, name)
    if at not in _WRITTEN:
        path = shared_dir(spark, "suite", f"{name}-{len(_WRITTEN)}")
        write(path)
        _WRITTEN[at] = path
    return _WRITTEN[at]


def _store(spark: SparkSession, d: str, name: str, build: Callable[[SampleStore], object]) -> SampleStore:
    return SampleStore(spark, _once(spark, d, name, lambda path: build(SampleStore(spark, path))))


def _rows(df: DataFrame) -> DataFrame:
    return df.select("event_id", "region", r6("amount").alias("amount"), "h")


# ======================================================================== A
@query
def scan_parquet(spark, d):
    register_tables(spark, d, ("events",))
    s = spark.sql("SELECT * FROM sales")
    return s.select("event_id", "user_id", "region", r6("amount").alias("amount"), "date")


@query
def gen_skewed_sales(spark, d):
    path = _once(spark, d, "gen", lambda p: write_parquet(derive_sales(read_table(spark, d, "events")), p))
    g = spark.read.parquet(path)
    return g.groupBy("region").agg(F.count(F.lit(1)).alias("rows"),
                                   r6(F.sum("amount")).alias("sum_amount"),
                                   r6(F.min("amount")).alias("min_amount"),
                                   r6(F.max("amount")).alias("max_amount"),
                                   F.count_distinct("user_id").alias("users"))


@query
def parquet_roundtrip(spark, d):
    path = _once(spark, d, "roundtrip", lambda p: write_parquet(_sales(spark, d), p))
    return _rows(spark.read.parquet(path))


@query
def group_distribution(spark, d):
    out = prof.group_distribution(load_sales(spark, d), "region")
    return out.select("region", "count", r6("pct").alias("pct"))


@query
def profile_snapshot(spark, d):
    import datetime as dt
    t0 = dt.datetime(2026, 1, 1, 12, 0, 0)
    path = _once(spark, d, "profile", lambda p: prof.save_profile(
        prof.profile_table(load_sales(spark, d), exact_cardinality=True), p, profiled_at=t0))
    fresh = prof.load_profile(spark, path, now=t0 + dt.timedelta(minutes=5))
    stale = prof.load_profile(spark, path, now=t0 + dt.timedelta(minutes=25))
    return fresh.select("column_name", "data_type", "row_count", "cardinality",
                        r6("mean").alias("mean"), r6("stddev").alias("stddev"),
                        F.lit(stale is None).alias("expires_after_ttl"))


# ======================================================================== B
def _exact(spark, d, aggs, group_by=(), where=None):
    return exact_aggregate(load_sales(spark, d), aggs, group_by, where)


CNT = ("count", "*", "cnt")
AVG = ("avg", "amount", "avg_amount")
SUM = ("sum", "amount", "total_revenue")


@query
def exact_count(spark, d):
    return _exact(spark, d, [CNT])


@query
def exact_avg(spark, d):
    return _exact(spark, d, [AVG]).select(r6("avg_amount").alias("avg_amount"))


@query
def exact_sum(spark, d):
    return _exact(spark, d, [SUM]).select(r6("total_revenue").alias("total_revenue"))


@query
def exact_multi_agg(spark, d):
    res = _exact(spark, d, [CNT, AVG, SUM, ("min", "amount", "min_amount"),
                            ("max", "amount", "max_amount")])
    return res.select("cnt", *[r6(c).alias(c) for c in
                               ("avg_amount", "total_revenue", "min_amount", "max_amount")])


@query
def exact_group_count(spark, d):
    return _exact(spark, d, [CNT], ["region"])


@query
def exact_group_stats(spark, d):
    res = _exact(spark, d, [CNT, AVG, SUM], ["region"])
    return res.select("region", "cnt", r6("avg_amount").alias("avg_amount"),
                      r6("total_revenue").alias("total_revenue"))


@query
def exact_count_distinct(spark, d):
    return _exact(spark, d, [("count_distinct", "user_id", "distinct_users")])


@query
def exact_median(spark, d):
    q = exact_quantiles(load_sales(spark, d), "amount", [0.5], "cont", ["median_amount"])
    return q.select(r6("median_amount").alias("median_amount"))


@query
def exact_p95(spark, d):
    q = exact_quantiles(load_sales(spark, d), "amount", [0.95], "cont", ["p95"])
    return q.select(r6("p95").alias("p95"))


@query
def exact_percentile_disc(spark, d):
    q = exact_quantiles(load_sales(spark, d), "amount", [0.95], "disc", ["p95_disc"])
    return q.select(r6("p95_disc").alias("p95_disc"))


@query
def exact_quantiles_narrowed(spark, d):
    """Six exact percentiles of a column of which a third is one value and a tenth NaN (SQL
    ranks NaN last), by narrowing rounds: at most 500 rows are left for the last step."""
    x = (F.when(F.col("event_id") % 3 == 0, F.lit(0.0)).when(F.col("event_id") % 10 == 1, F.lit(float("nan")))
         .otherwise(F.col("amount").cast("double"))).alias("x")
    q = exact_quantiles(load_sales(spark, d).select(x), "x", NARROWED, names=[f"q{i}" for i in range(len(NARROWED))],
                        small=500)
    return q.select(*[r6(F.nanvl(c, F.lit(-1.0))).alias(c) for c in q.columns])  # -1 stands for NaN


@query
def exact_quantiles_narrowed_grouped(spark, d):
    """The same per region, where one region holds most rows."""
    x = F.when(F.col("event_id") % 3 == 0, F.lit(0.0)).otherwise(F.col("amount").cast("double")).alias("x")
    names = [f"q{i}" for i in range(len(NARROWED))]
    q = exact_quantiles_grouped(load_sales(spark, d).select("region", x), "region", "x", NARROWED, names=names,
                                small=500)
    return q.select("region", *[r6(c).alias(c) for c in names])


@query
def exact_filter_numeric(spark, d):
    return _exact(spark, d, [CNT], where=F.col("amount") > 50)


@query
def exact_filter_equality(spark, d):
    res = _exact(spark, d, [CNT, AVG], where=F.col("region") == "US")
    return res.select("cnt", r6("avg_amount").alias("avg_amount"))


@query
def exact_filter_group(spark, d):
    return _exact(spark, d, [CNT], ["region"], where=F.col("amount") > 50)


# ======================================================================== C
@query
def sample_uniform_rows(spark, d):
    return _rows(sampling.uniform_sample(_sales(spark, d), UNIFORM_RATE))


@query
def sample_native(spark, d):
    """Tolerance: Spark's Bernoulli sampler keeps n rows with
    |n - N r| <= 4 sqrt(N r (1 - r))."""
    s = load_sales(spark, d)
    n = sampling.uniform_sample(s, UNIFORM_RATE, method="bernoulli", seed=7) \
        .agg(F.count(F.lit(1)).alias("n"))
    pop = s.agg(F.count(F.lit(1)).alias("population_rows"))
    r = UNIFORM_RATE
    j = with_scalars(pop, n)
    ok = F.abs(F.col("n") - F.col("population_rows") * r) <= \
        4 * F.sqrt(F.col("population_rows") * r * (1 - r))
    return j.select("population_rows", ok.alias("within_tolerance"))


@query
def sample_blocks(spark, d):
    """A quarter of the files instead of a quarter of the rows. Tolerance: COUNT, SUM and
    AVG within twice the stated margin; only the chosen files are read."""
    path = _once(spark, d, "many-files", lambda p: write_parquet(load_sales(spark, d).repartition(48, "event_id"), p))
    picked = block_sample(spark, path, 0.25)
    est = block_aggregate(picked, [CNT, SUM, AVG])
    exact = exact_aggregate(load_sales(spark, d), [CNT, SUM, AVG]).select(
        "cnt", r6("total_revenue").alias("total_revenue"), r6("avg_amount").alias("avg_amount"))
    names = ("cnt", "total_revenue", "avg_amount")
    j = with_scalars(exact, est.select(*[F.col(n).alias(f"e_{n}") for n in names],
                                       *[F.col(f"{n}_ci_high").alias(f"h_{n}") for n in names], "sample_blocks", "blocks"))
    return j.select(*names, "sample_blocks", "blocks", *[
        (F.abs(F.col(f"e_{n}") - F.col(n)) <= 2 * (F.col(f"h_{n}") - F.col(f"e_{n}"))).alias(f"{n}_within")
        for n in names], F.lit(len(picked.rows.inputFiles())).alias("files_read"))


def _null_keyed(spark, d) -> DataFrame:
    """Sales by a key that half of all rows lack, in strata of which one has no key at all."""
    e = F.col("event_id")
    return load_sales(spark, d).select(
        F.when((e % 2 == 0) & (e % 97 != 0), e).alias("k"),
        F.when(e % 97 == 0, F.lit("keyless")).otherwise(F.col("region")).alias("stratum"), "amount")


@query
def sample_null_keys(spark, d):
    """A 100 % sample has all rows, those without a key too."""
    res = sampling.sample_aggregate(_null_keyed(spark, d), [CNT, SUM], 1.0, ["stratum"], key="k", with_bounds=False)
    return res.select("stratum", "cnt", r6("total_revenue").alias("total_revenue"))


@query
def stratified_null_keys(spark, d):
    """A stratum without any key is represented like every other."""
    s = _null_keyed(spark, d)
    est = stratified.stratified_aggregate(s, "stratum", [CNT], STRAT_RATE, key="k")
    rows = stratified.stratified_sample(s, "stratum", STRAT_RATE, key="k").groupBy(F.col("stratum").alias("s")) \
        .agg(F.count("*").alias("rows"))
    j = est.join(rows, est["stratum"].eqNullSafe(rows["s"]))
    return j.select("stratum", "cnt", "sample_count", "population_count",
                    (F.col("rows") == F.col("sample_count")).alias("rows_agree"))


def _sample_agg(spark, d, aggs, group_by=(), where=None, with_bounds=False):
    return sampling.sample_aggregate(_sales(spark, d), aggs, UNIFORM_RATE, group_by, where,
                                     with_bounds=with_bounds)


@query
def sample_agg(spark, d):
    res = _sample_agg(spark, d, [CNT, AVG, SUM, ("min", "amount", "min_amount"),
                                 ("max", "amount", "max_amount")])
    return res.select(F.col("cnt_sample").alias("cnt"), r6("avg_amount").alias("avg_amount"),
                      r6("total_revenue_sample").alias("total_revenue"),
                      r6("min_amount").alias("min_amount"), r6("max_amount").alias("max_amount"))


@query
def sample_scaled_count(spark, d):
    res = _sample_agg(spark, d, [CNT])
    return res.select(F.col("cnt_sample").alias("cnt_sample"), F.col("cnt").alias("cnt_estimate"))


@query
def sample_scaled_sum(spark, d):
    res = _sample_agg(spark, d, [SUM])
    return res.select(r6("total_revenue_sample").alias("sum_sample"),
                      r6("total_revenue").alias("sum_estimate"))


@query
def sample_group(spark, d):
    res = _sample_agg(spark, d, [CNT, AVG, SUM], ["region"])
    return res.select("region", F.col("cnt_sample").alias("cnt"), r6("avg_amount").alias("avg_amount"),
                      r6("total_revenue_sample").alias("total_revenue"))


@query
def sample_filter_group(spark, d):
    res = _sample_agg(spark, d, [CNT], ["region"], where=F.col("amount") > 50)
    return res.select("region", F.col("cnt_sample").alias("cnt"), F.col("cnt").alias("cnt_estimate"))


@query
def sample_count_error(spark, d):
    """A COUNT bound attached to every row of a grouped sample result."""
    counts = _sample_agg(spark, d, [CNT], ["region"]).select(
        "region", F.col("cnt_sample").alias("count_sample"))
    res = sampling.count_with_error(counts, "count_sample", UNIFORM_RATE)
    return res.select("region", "count_sample", "estimated_total", "error_pct", "ci_low", "ci_high")


PRIORITY_K = 400
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _r2(df: DataFrame, but: list[str]) -> list[Column]:
    """The other columns with two decimals (sums of doubles differ in the last bits by engine)."""
    return [F.round(F.col(c), 2).alias(c) for c in df.columns if c not in but]


@query
def sample_priority(spark, d):
    """The rows of a priority sample by price, with their inclusion probabilities."""
    li = read_table(spark, d, "lineitem").withColumn("weight", F.pow(F.col("l_extendedprice"), F.lit(2)) * (F.col("l_linenumber") > 3).cast("int"))
    return priority_sample(li, PRIORITY_K, "weight", LINE_KEY).select(*LINE_KEY, r6("inclusion").alias("inclusion"))


@query
def priority_sum(spark, d):
    """COUNT, SUM and AVG per group from a stored priority sample."""
    li = read_table(spark, d, "lineitem")
    st = _store(spark, d, "priority", lambda st: st.build_priority(li, "lineitem", PRIORITY_K, "l_extendedprice", LINE_KEY))
    res = priority_aggregate(st.priority("lineitem", "l_extendedprice"),
                             [("sum", "l_extendedprice", "total"), ("count", "*", "cnt"), ("avg", "l_quantity", "qty")],
                             ["l_returnflag"], "l_discount > 0.02")
    return res.select("l_returnflag", *_r2(res, ["l_returnflag", "sample_rows"]), "sample_rows")


OUTLIER_K = 60


def _costs(spark, d):
    """``events`` with a heavy-tailed ``cost``: the cube of the value."""
    return read_table(spark, d, "events").withColumn("cost", F.col("value") * F.col("value") * F.col("value"))


@query
def outlier_rows(spark, d):
    """H2: the rows of an outlier index of 60 rows by cost."""
    ev = _costs(spark, d)
    return ev.where(is_outlier("cost", outlier_cut(ev, "cost", OUTLIER_K))).select("event_id", r6("cost").alias("cost"))


@query
def outlier_sum(spark, d):
    """H2/E5: COUNT, SUM and AVG of the cost per event type under a filter, from the stored index
    and the other rows of the 10 % tier."""
    ev = _costs(spark, d)
    st = _store(spark, d, "outliers", lambda st: (st.build_tiers(ev, "events", "event_id"),
                                                  st.build_outliers(ev, "events", "cost", OUTLIER_K)))
    res = st.outlier_aggregate("events", "cost", UNIFORM_RATE,
                               [("sum", "cost", "total"), ("count", "*", "cnt"), ("avg", "cost", "mean")],
                               ["event_type"], "user_id % 4 < 3")
    return res.select("event_type", *_r2(res, ["event_type", "index_rows", "sample_rows"]), "index_rows", "sample_rows")


@query
def bootstrap_bounds(spark, d):
    """H1-H3: Poisson bootstrap intervals of a count, a sum and a ratio of two sums per group."""
    li = read_table(spark, d, "lineitem")
    aggs = [("count", "*", "cnt"), ("sum", "l_extendedprice", "total"),
            Ratio("discount_pct", "100 * l_extendedprice * l_discount", "l_extendedprice")]
    res = bootstrap_aggregate(sampling.uniform_sample(li, UNIFORM_RATE, LINE_KEY), aggs, UNIFORM_RATE, ["l_returnflag"])
    return res.select("l_returnflag", *_r2(res, ["l_returnflag", "sample_rows"]), "sample_rows")


@query
def bootstrap_median(spark, d):
    """Q4: median and 90th percentile per group of a sample, with bootstrap intervals (twice as
    wide they hold the exact values, and they are narrow)."""
    li = read_table(spark, d, "lineitem")
    aggs = [("median", "l_extendedprice", "med"), ("percentile", "l_extendedprice", "p90", 0.9)]
    res = bootstrap_aggregate(sampling.uniform_sample(li, UNIFORM_RATE, LINE_KEY, hash_method="xxhash"), aggs, UNIFORM_RATE,
                              ["l_returnflag"], hash_method="xxhash")
    exact = exact_quantiles_grouped(li, "l_returnflag", "l_extendedprice", (0.5, 0.9), names=("exact_med", "exact_p90"))
    j = join_on_groups(res, exact, ["l_returnflag"], "inner")
    out = ["l_returnflag"]
    for x in ("med", "p90"):
        out += [r6(f"exact_{x}").alias(f"exact_{x}"),
                F.col(f"exact_{x}").between(2 * F.col(f"{x}_ci_low") - F.col(x), 2 * F.col(f"{x}_ci_high") - F.col(x)).alias(f"{x}_within"),
                (F.col(f"{x}_error_pct") < 60).alias(f"{x}_bounded")]
    return j.select(*out)


@query
def distinct_sets(spark, d):
    """distinct pairs of user and whole value by combined event types, from stored theta
    sketches of 512 keys: the exact count lies in the stated interval."""
    ev = read_table(spark, d, "events").withColumn("pair", F.col("user_id") * 100_000 + F.floor("value"))
    path = _once(spark, d, "theta", lambda p: write_parquet(value_sketches(ev, "pair", ["event_type"], 9), p))
    click, error, view = (is_in("event_type", t) for t in ("click", "error", "view"))
    got = distinct_in(spark.read.parquet(path), {"both": click & error, "either": click | error, "click_only": click - error - view,
                                                 "unknown": is_in("event_type", "never")}, 0.9999)
    per = ev.groupBy("pair").agg(*[F.max(F.col("event_type") == t).alias(t) for t in ("click", "error", "view")])
    exact = per.agg(F.struct(F.expr("count_if(click AND error)").alias("both"), F.expr("count_if(click OR error)").alias("either"),
                             F.expr("count_if(click AND NOT error AND NOT view)").alias("click_only"), F.lit(0).cast("long").alias("unknown"))
                    .alias("x"))
    j = with_scalars(got, exact)
    right = F.element_at(F.create_map(*[c for k in ("both", "either", "click_only", "unknown")
                                        for c in (F.lit(k), F.col("x").getField(k))]), F.col("set_name"))
    return j.select("set_name", right.alias("exact"), right.between(F.floor("ci_low"), F.ceil("ci_high")).alias("within"))


def _summed(spark, d, name: str, files: int, *order: str) -> tuple[str, DataFrame]:
    """``sales`` in ``files`` files (in ranges of ``order``, or dealt by hash), and their summaries."""
    def write(p):
        s = load_sales(spark, d).select("event_id", "region", "amount")
        (s.repartitionByRange(files, *order) if order else s.repartition(files, F.xxhash64("event_id"))).write.parquet(p)
    path = _once(spark, d, name, write)
    stored_at = _once(spark, d, name + "-sums", lambda p: write_parquet(
        file_summaries(spark, path, ["event_id"], ["amount"], ["region"]), p))
    return path, spark.read.parquet(stored_at)


_RANGE_AGGS = [("count", "*", "cnt"), ("sum", "amount", "total"), ("avg", "amount", "mean")]


@query
def summary_range(spark, d):
    """A range filter on an ordered table of 24 files opens the two files at its ends only, and
    is exact."""
    path, sums = _summed(spark, d, "ordered", 24, "event_id")
    n = sums.agg(F.max("most_event_id")).first()[0] + 1
    res = range_aggregate(spark, path, sums, "event_id", n // 5, n - n // 3, _RANGE_AGGS, ["region"])
    return res.select("region", r6("cnt").alias("cnt"), F.round("total", 2).alias("total"), r6("mean").alias("mean"),
                      F.col("total_error_pct").alias("error_pct"), (F.col("files_read") <= 2).alias("ends_only"),
                      (F.col("files_inside") > 8).alias("most_from_summaries"))


@query
def summary_sampled(spark, d):
    """The same filter where every file straddles the range: 24 of 64 files are drawn, and the
    exact answers lie in twice the stated intervals."""
    path, sums = _summed(spark, d, "dealt", 64)
    n = sums.agg(F.max("most_event_id")).first()[0] + 1
    res = range_aggregate(spark, path, sums, "event_id", n // 5, n - n // 3, _RANGE_AGGS, max_files=24)
    s = load_sales(spark, d).where(f"event_id BETWEEN {n // 5} AND {n - n // 3}")
    exact = s.agg(F.count("*").alias("exact_cnt"), r6(F.sum("amount")).alias("exact_total"))
    j = with_scalars(res, exact)
    return j.select("exact_cnt", "exact_total", *[
        (F.abs(F.col(x) - F.col(f"exact_{x}")) <= 2 * (F.col(f"{x}_ci_high") - F.col(x))).alias(f"{x}_within") for x in ("cnt", "total")],
        (F.col("files_read") == 24).alias("drawn"))


@query
def universe_join(spark, d):
    """C4/E5: COUNT, SUM and AVG over a join, from 10 % of the join keys on both sides."""
    aggs = [("count", "*", "cnt"), ("sum", "l_extendedprice", "total"), ("avg", "l_extendedprice", "price")]
    li, orders = read_table(spark, d, "lineitem"), read_table(spark, d, "orders")
    st = _store(spark, d, "universe", lambda st: (st.build_universe(li, "lineitem", "l_orderkey", 0.2),
                                                  st.build_universe(orders, "orders", "o_orderkey", UNIFORM_RATE)))
    res = st.join_aggregate("lineitem", "orders", "l_orderkey", "o_orderkey", aggs, ["o_orderpriority"], "l_quantity > 10")
    return res.select("o_orderpriority", *_r2(res, ["o_orderpriority", "sample_keys"]), "sample_keys")


@query
def allocated_strata(spark, d):
    """A budget of 5 % of the rows dealt to strata of very different sizes by their spread:
    the budget is kept, and the worst margin of the strata's sums is below that of one rate for all."""
    li = read_table(spark, d, "lineitem").withColumn("grp", F.floor(F.log2(F.greatest("l_partkey", F.lit(1)))).cast("int")) \
        .select("grp", "l_extendedprice", *LINE_KEY)
    n = li.count()
    aggs = [("sum", "l_extendedprice", "total")]
    strata = allocate(li, "grp", "l_extendedprice", n // 20)
    dealt = allocated_aggregate(allocated_sample(li, strata, "grp", LINE_KEY), "grp", aggs)
    equal = stratified.stratified_aggregate(li, "grp", aggs, 0.05, LINE_KEY)
    exact = li.groupBy(F.col("grp").alias("g")).agg(F.sum("l_extendedprice").alias("exact"))
    worst = [x.agg(F.max(F.coalesce("total_error_pct", F.lit(1e300))).alias(k)) for x, k in ((dealt, "dealt"), (equal, "equal"))]
    used = strata.agg(F.sum("target_rows").alias("used"))
    j = with_scalars(dealt.join(exact, F.col("grp") == F.col("g")), *worst, used)
    return j.select("grp", "population_count", (F.abs(F.col("used") - n // 20) <= 0.001 * n).alias("budget_kept"),
                    (F.col("dealt") < 0.8 * F.col("equal")).alias("worst_is_less"),
                    (F.abs(F.col("total") - F.col("exact")) <= 2 * (F.col("total_ci_high") - F.col("total")) + 0.01).alias("within"))


# ======================================================================== S
@query
def strata_distinct(spark, d):
    return stratified.strata_distinct(load_sales(spark, d), "region")


@query
def stratified_rows(spark, d):
    return _rows(stratified.stratified_sample(_sales(spark, d), "region", STRAT_RATE))


@query
def strata_population(spark, d):
    return stratified.strata_table(_sales(spark, d), "region", STRAT_RATE).select(
        "region", "population_count", "below_count", "sample_count", "min_h")


def _strat(spark, d, aggs, where=None):
    return stratified.stratified_aggregate(_sales(spark, d), "region", aggs, STRAT_RATE, where=where)


@query
def stratified_count(spark, d):
    return _strat(spark, d, [CNT]).select("region", "cnt", "cnt_sample", "sample_count",
                                          "population_count", "error_pct")


@query
def stratified_sum(spark, d):
    return _strat(spark, d, [SUM]).select("region", r6("total_revenue").alias("total_revenue"),
                                          r6("total_revenue_sample").alias("total_revenue_sample"))


@query
def stratified_avg(spark, d):
    return _strat(spark, d, [AVG]).select("region", r6("avg_amount").alias("avg_amount"))


@query
def stratified_minmax(spark, d):
    res = _strat(spark, d, [("min", "amount", "min_amount"), ("max", "amount", "max_amount")])
    return res.select("region", r6("min_amount").alias("min_amount"), r6("max_amount").alias("max_amount"))


@query
def stratified_error(spark, d):
    return _strat(spark, d, [CNT]).select("region", "sample_count", "population_count", "error_pct")


@query
def stratified_bounds(spark, d):
    """Per-stratum confidence intervals of SUM and AVG (10 % stratified)."""
    res = stratified.stratified_aggregate(_sales(spark, d), "region", [SUM, AVG], UNIFORM_RATE)
    return res.select("region", r6("total_revenue").alias("total_revenue"),
                      "total_revenue_ci_low", "total_revenue_ci_high",
                      r6("avg_amount").alias("avg_amount"), "avg_amount_ci_low", "avg_amount_ci_high",
                      "sample_count")


@query
def stratified_filtered(spark, d):
    """Filter on a stratified sample: COUNT scales by N_g/n_g of the unfiltered stratum."""
    res = _strat(spark, d, [CNT, SUM], where=F.col("amount") > 50)
    return res.select("region", "cnt", "cnt_sample", r6("total_revenue").alias("total_revenue"),
                      "sample_count", "population_count", "cnt_ci_low", "cnt_ci_high", "cnt_error_pct")


@query
def stratified_filtered_rare(spark, d):
    """A selective filter: strata without a sampled match stay, with an upper bound."""
    res = _strat(spark, d, [CNT, SUM], where=F.col("user_id") < 2)
    return res.select("region", "cnt", "cnt_sample", r6("total_revenue").alias("total_revenue"),
                      "cnt_ci_low", "cnt_ci_high")


@query
def stratified_filtered_sum(spark, d):
    """A filter that 2 % of the rows pass: the interval of the SUM counts that it is not known
    how many rows of a stratum match."""
    res = stratified.stratified_aggregate(
        read_table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"],
        [("sum", "l_quantity", "sum_qty"), ("avg", "l_quantity", "avg_qty")], UNIFORM_RATE,
        key=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], where="l_partkey % 50 = 7")
    return res.select("l_returnflag", "l_linestatus", *[r6(c).alias(c) for c in (
        "sum_qty", "sum_qty_ci_low", "sum_qty_ci_high", "sum_qty_error_pct",
        "avg_qty", "avg_qty_ci_low", "avg_qty_ci_high")])


@query
def stratified_count_lineitem(spark, d):
    """Stratified COUNT/SUM on a second table, by two group columns, with the
    four-column lineitem row key."""
    li = read_table(spark, d, "lineitem")
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    res = stratified.stratified_aggregate(li, ["l_returnflag", "l_linestatus"],
                                          [("count", "*", "cnt"), ("sum", "l_quantity", "sum_qty")],
                                          STRAT_RATE, key=key)
    return res.select("l_returnflag", "l_linestatus", "cnt", r6("sum_qty").alias("sum_qty"),
                      "sample_count", "population_count", "error_pct")


@query
def stratified_documents_lang(spark, d):
    """Stratified estimate on a naturally skewed text table: documents and
    average length per language (only doc_id, lang and n_chars are read)."""
    docs = read_table(spark, d, "documents")
    res = stratified.stratified_aggregate(docs, "lang", [("count", "*", "docs"),
                                                         ("avg", "n_chars", "avg_chars"),
                                                         ("sum", "n_chars", "total_chars")],
                                          UNIFORM_RATE, key="doc_id")
    return res.select("lang", "docs", r6("avg_chars").alias("avg_chars"),
                      r6("total_chars").alias("total_chars"), "sample_count", "population_count",
                      "error_pct")


# ======================================================================== E
def _built(spark, d, name="samples"):
    """The stored samples of the sales table (built once a session) and the table."""
    s = _sales(spark, d)

    def build(st: SampleStore) -> None:
        st.build_tiers(s, "sales", "event_id", DEFAULT_TIERS)
        st.build_stratified(s, "sales", "region", "event_id", UNIFORM_RATE)
    return _store(spark, d, name, build), s


def _registry(st: SampleStore) -> DataFrame:
    return st.registry().select("table_name", "sample_type", r6("rate").alias("rate"),
                                "group_cols", "sample_rows", "population_rows", "stored_rows",
                                r6("realised_rate").alias("realised_rate"),
                                r6("storage_overhead").alias("storage_overhead"))


@query
def sample_tiers_build(spark, d):
    st, _ = _built(spark, d)
    data = spark.read.parquet(st._meta_row("sales", "20pct")["data_path"])
    return data.select("event_id", "region", r6("amount").alias("amount"), "h", "tier_ppm")


@query
def sample_stratified_build(spark, d):
    st, _ = _built(spark, d)
    return _rows(st.stratified_rows("sales", "region"))


@query
def sample_registry(spark, d):
    st, _ = _built(spark, d)
    return _registry(st)


@query
def sample_tier_choice(spark, d):
    st, _ = _built(spark, d)
    reg = st.registry().filter(F.col("sample_type") != "stratified")
    lv = reg.withColumn("accuracy", F.explode(F.array(*[F.lit(a) for a in ACCURACY_LEVELS])))
    return (lv.filter(F.abs(bounds.tier_for_accuracy("accuracy") - F.col("rate")) < 1e-12)
            .select(r6("accuracy").alias("accuracy"), "sample_type", r6("rate").alias("rate"),
                    "sample_rows"))


@query
def materialized_agg(spark, d):
    st, _ = _built(spark, d)
    res = st.tier_aggregate("sales", [CNT, SUM, AVG], accuracy=0.90)
    return res.select("cnt", "cnt_sample", "cnt_error_pct", r6("total_revenue").alias("total_revenue"),
                      r6("avg_amount").alias("avg_amount"), r6("sample_rate").alias("sample_rate"),
                      "sample_type")


@query
def materialized_group(spark, d):
    st, _ = _built(spark, d)
    res = st.stratified_aggregate("sales", "region", [CNT, SUM])
    return res.select("region", "cnt", "cnt_sample", r6("total_revenue").alias("total_revenue"),
                      "sample_count", "population_count", "error_pct")


@query
def materialized_filter(spark, d):
    st, _ = _built(spark, d)
    res = st.tier_aggregate("sales", [CNT, SUM], rate=0.10, where=F.col("amount") > 50)
    return res.select("cnt", "cnt_sample", r6("total_revenue").alias("total_revenue"),
                      r6("sample_rate").alias("sample_rate"))


@query
def sample_refresh(spark, d):
    st, s = _built(spark, d, "refresh")
    st.refresh("sales", s)
    return _registry(st)


@query
def sample_rebuild_rates(spark, d):
    """Tiers rebuilt at other rates from changed data replace all tiers of the older
    build; registry and answers know the new data only."""
    s = _sales(spark, d)

    def build(st: SampleStore) -> None:
        st.build_tiers(s, "sales", "event_id", DEFAULT_TIERS)
        st.build_tiers(s.filter("event_id % 2 = 0"), "sales", "event_id", (0.05, 0.25))
    st = _store(spark, d, "rebuild", build)
    reg = _registry(st).select("sample_type", "rate", "sample_rows", "population_rows")
    est = st.tier_aggregate("sales", [CNT], rate=0.05).select(F.col("cnt").alias("cnt_estimate"))
    return with_scalars(reg, est)


@query
def sample_incremental(spark, d):
    """Samples of a table in files; after two appends only the new files were read, and tiers
    and strata are those of a full build (strata of one row in a thousand included)."""
    s = load_sales(spark, d)
    table = shared_dir(spark, "suite", "growing", uuid.uuid4().hex)
    s.where("event_id % 3 = 0").repartition(3).write.parquet(table)
    st = SampleStore(spark, table + "-samples")
    build_from_files(st, table, "sales", "event_id", strata=[(["region"], 0.005)])
    read = 0
    for rest in (1, 2):
        s.where(f"event_id % 3 = {rest}").repartition(rest).write.mode("append").parquet(table)
        read += len(append_files(st, table, "sales", max_parts=2).files)
    rows = st.tier("sales", 0.2).select("event_id", F.lit("tier").alias("sample")).unionByName(
        st.stratified_rows("sales", "region").select("event_id", F.lit("strata").alias("sample")))
    sizes = st.strata("sales", "region").agg(F.sum("population_count").alias("population"),
                                             F.sum("sample_count").alias("strata_rows"))
    return with_scalars(rows, sizes).withColumn("files_read", F.lit(read))


@query
def profile_invalidate(spark, d):
    """A refresh makes the table's profile stale; it keeps the version it replaced and
    says what it created."""
    st, s = _built(spark, d, "refresh")
    path = shared_dir(spark, "suite", "profile-to-refresh")
    prof.cached_profile(load_sales(spark, d), path)
    fresh = prof.load_profile(spark, path) is not None
    done = st.refresh("sales", s, profile_path=path)
    stale = prof.load_profile(spark, path) is None
    created = done.agg(F.count_if(F.col("action") == "created").alias("created"))
    return created.select("created", F.lit(fresh).alias("fresh_before"), F.lit(stale).alias("stale_after"))


# ======================================================================== F
def _within(est: Column, exact: Column, rel: float) -> Column:
    return F.abs(est - exact) <= F.lit(rel) * exact


@query
def approx_distinct(spark, d):
    s = load_sales(spark, d)
    r = with_scalars(s.agg(F.count_distinct("user_id").alias("distinct_users")),
                     sketches.approx_distinct(s, "user_id", alias="e"))
    return r.select("distinct_users",
                    _within(F.col("e"), F.col("distinct_users"), 3 * sketches.DEFAULT_RSD)
                    .alias("within_tolerance"))


@query
def approx_distinct_filtered(spark, d):
    s = load_sales(spark, d).filter(F.col("amount") > 50)
    r = with_scalars(s.agg(F.count_distinct("user_id").alias("distinct_users")),
                     sketches.approx_distinct(s, "user_id", alias="e"))
    return r.select("distinct_users",
                    _within(F.col("e"), F.col("distinct_users"), 3 * sketches.DEFAULT_RSD)
                    .alias("within_tolerance"))


@query
def approx_distinct_keys(spark, d):
    """A column of as many values as orders, at three precisions: within three times the
    stated error of each."""
    li = read_table(spark, d, "lineitem")
    exact = li.agg(F.count_distinct("l_orderkey").alias("distinct_keys"))
    r = with_scalars(exact, *[sketches.approx_distinct(li, "l_orderkey", rsd=e, alias=f"e{i}")
                              for i, e in enumerate(KEY_RSD)])
    return r.select("distinct_keys", *[_within(F.col(f"e{i}"), F.col("distinct_keys"), 3 * e).alias(f"within_{i}")
                                       for i, e in enumerate(KEY_RSD)])


@query
def approx_distinct_grouped(spark, d):
    s = load_sales(spark, d)
    r = join_on_groups(s.groupBy("region").agg(F.count_distinct("user_id").alias("distinct_users")),
                       sketches.approx_distinct(s, "user_id", ["region"], alias="e"), ["region"])
    return r.select("region", "distinct_users",
                    _within(F.col("e"), F.col("distinct_users"), 3 * sketches.DEFAULT_RSD)
                    .alias("within_tolerance"))


@query
def approx_distinct_orders(spark, d):
    """Distinct customers with orders, per order status (HLL, tolerance)."""
    o = read_table(spark, d, "orders")
    r = join_on_groups(o.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers")),
                       sketches.approx_distinct(o, "o_custkey", ["o_orderstatus"], alias="e"), ["o_orderstatus"])
    return r.select("o_orderstatus", "customers",
                    _within(F.col("e"), F.col("customers"), 3 * sketches.DEFAULT_RSD)
                    .alias("within_tolerance"))


@query
def hll_distinct(spark, d):
    p = sketches.DEFAULT_HLL_P
    s = load_sales(spark, d)
    est = sketches.hll_distinct(s, "user_id", p, alias="e")  # two-level merge
    r = with_scalars(s.agg(F.count_distinct("user_id").alias("distinct_users")), est)
    tol = 3 * sketches.hll_error_pct(p) / 100
    return r.select("distinct_users", _within(F.col("e"), F.col("distinct_users"), tol)
                    .alias("within_tolerance"))


@query
def hll_precision_sweep(spark, d):
    s = load_sales(spark, d)
    r = with_scalars(s.agg(F.count_distinct("user_id").alias("distinct_users")),
                     sketches.hll_sweep(s, "user_id", HLL_PRECISIONS))
    rows = F.explode(F.array(*[F.struct(F.lit(p).alias("precision"), F.col(f"e{p}").alias("e"))
                               for p in HLL_PRECISIONS])).alias("x")
    x = r.select("distinct_users", rows)
    err = bounds.hll_error_pct("x.precision")
    ok = F.abs(F.col("x.e") - F.col("distinct_users")) <= 3 * err / 100 * F.col("distinct_users")
    return x.select(F.col("x.precision").cast("bigint").alias("precision"),
                    r6(err).alias("error_pct"), "distinct_users", ok.alias("within_tolerance"))


@query
def hll_merge(spark, d):
    """Per-region sketches merged: the union's estimate agrees with one
    sketch over all rows (equal while the sketches are sparse; within the
    sketch error once a directly built sketch switches to its HIP
    estimator), and is within tolerance of the exact count."""
    p = sketches.DEFAULT_HLL_P
    s = load_sales(spark, d)
    per = sketches.hll_sketches(s, "user_id", ["region"], p)
    merged = sketches.merge_hll(per, alias="merged")
    j = with_scalars(s.agg(F.count_distinct("user_id").alias("distinct_users")), merged,
                     sketches.hll_distinct(s, "user_id", p, alias="direct"))
    tol = 3 * sketches.hll_error_pct(p) / 100
    return j.select("distinct_users",
                    _within(F.col("merged"), F.col("direct"), tol).alias("merge_agrees_with_direct"),
                    _within(F.col("merged"), F.col("distinct_users"), tol).alias("within_tolerance"))


# ======================================================================== Q
def _quantile_check(df: DataFrame, col: str, probs, est: DataFrame, eps, group_by=()):
    """Exact quantile per probability plus a rank check of the estimate.

    ``est`` has one column per probability, named by ``quantile_name``, and one
    row (per group). An estimate passes when the share of rows at or below it
    reaches ``p - eps`` and the share strictly below it stays under ``p + eps``.
    ``eps`` is a number, or a function of the probability and the row count. All
    probabilities share one pass each for the ranks and for every round of the
    exact selection.
    """
    g, probs = list(group_by), list(probs)
    names = [sketches.quantile_name(p) for p in probs]
    x = F.col(col).cast("double")
    est = est.select(*g, *[F.col(n).alias(f"e{i}") for i, n in enumerate(names)])
    j = df.join(est, g) if g else with_scalars(df, est)
    cnt = [F.count(x).alias("n")]
    for i in range(len(probs)):
        e = F.col(f"e{i}")
        cnt += [F.count_if(x < e).alias(f"lt{i}"), F.count_if(x <= e).alias(f"le{i}")]
    ranks = j.groupBy(*g).agg(*cnt) if g else j.agg(*cnt)
    own = [f"x{i}" for i in range(len(probs))]
    if g:
        both = ranks.join(exact_quantiles_grouped(df, g, col, probs, names=own), g)
    else:
        both = with_scalars(ranks, exact_quantiles(df, col, probs, names=own))
    n = F.col("n")

    def ok(i: int, p: float) -> Column:
        tol = eps(p, n) if callable(eps) else F.lit(eps)
        return (F.col(f"le{i}") / n >= p - tol) & (F.col(f"lt{i}") / n <= p + tol)
    rows = F.explode(F.array(*[F.struct(
        F.lit(name).alias("quantile"), F.lit(float(p)).alias("p"),
        F.col(f"x{i}").alias("exact"), ok(i, p).alias("ok"))
        for i, (p, name) in enumerate(zip(probs, names))])).alias("q")
    return both.select(*g, rows).select(
        *g, "q.quantile", r6("q.p").alias("p"), r6("q.exact").alias("exact_value"),
        F.col("q.ok").alias("within_rank_tolerance"))


@query
def approx_median(spark, d):
    s = load_sales(spark, d)
    return _quantile_check(s, "amount", [0.5], sketches.approx_quantiles(s, "amount", [0.5]), RANK_EPS)


@query
def approx_percentiles(spark, d):
    s = load_sales(spark, d)
    return _quantile_check(s, "amount", PERCENTILES, sketches.approx_quantiles(s, "amount", PERCENTILES), RANK_EPS)


@query
def kll_quantile(spark, d):
    s = load_sales(spark, d)
    est = sketches.kll_quantiles(s, "amount", PERCENTILES, k=KLL_K)
    res = _quantile_check(s, "amount", PERCENTILES, est, KLL_EPS)
    return res.withColumn("error_estimate", F.lit(sketches.kll_error_estimate(KLL_K)))


@query
def sampled_quantile(spark, d):
    """Q4: quantiles of a 10 % sample against the whole table; the tolerance adds four
    standard errors of the sampled share."""
    s = _sales(spark, d)
    est = sketches.approx_quantiles(sampling.uniform_sample(s, UNIFORM_RATE), "amount", [0.5, 0.95])
    return _quantile_check(s, "amount", [0.5, 0.95], est, lambda p, n: RANK_EPS + 4 * F.sqrt(
        F.lit(p * (1 - p) / UNIFORM_RATE) / n))


@query
def kll_merge(spark, d):
    """Per-region KLL sketches merged, checked against the whole table."""
    s = load_sales(spark, d)
    merged = sketches.merge_kll(sketches.kll_sketches(s, "amount", ["region"], KLL_K), PERCENTILES)
    return _quantile_check(s, "amount", PERCENTILES, merged, KLL_EPS)


@query
def approx_median_grouped(spark, d):
    s = load_sales(spark, d)
    est = sketches.approx_quantiles(s, "amount", [0.5], ["region"])
    return _quantile_check(s, "amount", [0.5], est, RANK_EPS, group_by=["region"])


# ======================================================================== P
def _profile(spark, d, exact=True):
    return prof.profile_table(load_sales(spark, d), exact_cardinality=exact)


@query
def profile_table(spark, d):
    """The default (mergeable) profile; only the cardinality column comes from the exact one."""
    exact = _profile(spark, d, True).select("ordinal", "cardinality")
    return _profile(spark, d, False).drop("cardinality").join(exact, "ordinal").select("ordinal", "column_name", "data_type", "is_numeric", "row_count",
                                     "cardinality", r6("mean").alias("mean"), r6("stddev").alias("stddev"))


@query
def profile_cardinality(spark, d):
    ex = _profile(spark, d, True).select("column_name", "cardinality")
    ap = _profile(spark, d, False).select("column_name", F.col("cardinality").alias("approx"))
    j = ex.join(ap, "column_name")
    return j.select("column_name", "cardinality",
                    (F.abs(F.col("approx") - F.col("cardinality")) <= 0.06 * F.col("cardinality"))
                    .alias("approx_within_tolerance"))


@query
def profile_numeric(spark, d):
    return _profile(spark, d, False).filter("is_numeric").select(
        "column_name", r6("mean").alias("mean"), r6("stddev").alias("stddev"))


@query
def profile_large_mean(spark, d):
    """The spread survives a mean that is ten million times as large."""
    s = load_sales(spark, d).select((F.col("amount").cast("double") + F.lit(1e9)).alias("x"))
    p = prof.profile_table(s).select("column_name", "row_count", F.round("mean", 2).alias("mean"),
                                     F.round("stddev", 3).alias("stddev"))
    return p


@query
def profile_histogram(spark, d):
    h = prof.histogram(load_sales(spark, d), "amount")
    return h.select("bin", r6("bin_lo").alias("bin_lo"), r6("bin_hi").alias("bin_hi"), "count")


@query
def profile_gini(spark, d):
    g = prof.histogram_gini(load_sales(spark, d), "amount")
    return g.select("groups", r6("gini").alias("gini"), r6("gini_normalised").alias("gini_normalised"))


@query
def profile_gini_category(spark, d):
    g = prof.frequency_gini(load_sales(spark, d), "region")
    return g.select("groups", r6("gini").alias("gini"), r6("gini_normalised").alias("gini_normalised"),
                    (F.col("gini_normalised") > prof.SKEW_GINI).alias("skewed"))


@query
def profile_skew(spark, d):
    """Frequency Gini of several columns in one plan (stored with a profile
    for the planner)."""
    g = prof.profile_skew(load_sales(spark, d), ["region", "user_id"])
    return g.select("column_name", "groups", r6("gini").alias("gini"),
                    r6("gini_normalised").alias("gini_normalised"))


@query
def heavy_values(spark, d):
    """The values that at least 2 % of the events have, of three columns (one is a key)."""
    ev = read_table(spark, d, "events")
    res = heavy_hitters(ev, ["event_type", "user_id", "event_id"], 0.02)
    return res.select("column_name", "value", "count", r6("share").alias("share"))


@query
def skew_interval(spark, d):
    """The exact frequency Gini lies in the interval from heavy hitters (300 tracked values)."""
    s = load_sales(spark, d)
    columns = ["region", "user_id", "event_id"]
    exact = prof.profile_skew(s, columns).select("column_name", "gini_normalised")
    j = join_on_groups(skew_bounds(s, columns, 300), exact, ["column_name"], "inner")
    g = F.coalesce("gini_normalised", F.lit(0.0))
    return j.select("column_name", r6(g).alias("gini_normalised"),
                    g.between(F.col("gini_low") - 1e-9, F.col("gini_high") + 1e-9).alias("within"))


@query
def profile_gini_users(spark, d):
    """Frequency Gini of a high-cardinality column (one group per user)."""
    g = prof.frequency_gini(read_table(spark, d, "orders"), "o_custkey")
    return g.select("groups", r6("gini").alias("gini"), r6("gini_normalised").alias("gini_normalised"))


# ======================================================================== H
@query
def count_error(spark, d):
    s = _sales(spark, d)
    rates = list(DEFAULT_TIERS)
    r = s.agg(*[F.count_if(F.col("h") < threshold(x)).alias(f"n{i}") for i, x in enumerate(rates)])
    x = r.select(F.explode(F.array(*[F.struct(F.lit(v).alias("rate"), F.col(f"n{i}").alias("n"))
                                     for i, v in enumerate(rates)])).alias("x"))
    b = bounds.count_bound("x.n", "x.rate")
    ht = bounds.count_bound("x.n", "x.rate", method="ht")
    return x.select(r6("x.rate").alias("rate"), F.col("x.n").alias("count_sample"),
                    b["estimated_total"].alias("estimated_total"), b["error_pct"].alias("error_pct"),
                    b["ci_low"].alias("ci_low"), b["ci_high"].alias("ci_high"),
                    ht["error_pct"].alias("ht_error_pct"))


def _group_sample_stats(spark, d):
    s = _sales(spark, d)
    below = F.col("h") < threshold(UNIFORM_RATE)
    amt = F.when(below, F.col("amount"))
    return s.groupBy("region").agg(F.count(F.lit(1)).alias("population_size"),
                                   F.count_if(below).alias("sample_size"),
                                   F.sum(amt).cast("double").alias("sample_sum"),
                                   F.stddev_samp(amt).alias("sample_std"))


@query
def sum_error(spark, d):
    g = _group_sample_stats(spark, d)
    b = bounds.sum_bound("sample_sum", "sample_std", "sample_size", "population_size")
    return g.select("region", "sample_size", "population_size", *[v.alias(k) for k, v in b.items()])


@query
def sum_error_ht(spark, d):
    """Horvitz-Thompson SUM interval per region from the 10 % hash sample."""
    res = sampling.sample_aggregate(_sales(spark, d), [SUM], UNIFORM_RATE, ["region"],
                                    bound_method="ht")
    return res.select("region", r6("total_revenue").alias("estimated_total"),
                      F.col("total_revenue_error_pct").alias("error_pct"),
                      F.col("total_revenue_ci_low").alias("ci_low"),
                      F.col("total_revenue_ci_high").alias("ci_high"))


@query
def avg_error(spark, d):
    g = _group_sample_stats(spark, d)
    b = bounds.avg_bound("sample_std", "sample_size", "population_size")
    return g.select("region", "sample_size", "population_size", *[v.alias(k) for k, v in b.items()])


@query
def sample_stats(spark, d):
    res = sampling.sample_stats(load_sales(spark, d), DEFAULT_TIERS)
    return res.select("population_size", "sample_size", r6("sample_rate").alias("sample_rate"))


@query
def accuracy_sample_rate(spark, d):
    p = _profile(spark, d, False).filter("is_numeric")
    x = p.withColumn("accuracy", F.explode(F.array(*[F.lit(a) for a in ACCURACY_LEVELS])))
    rate = bounds.accuracy_to_rate("accuracy", "mean", "stddev", "row_count")
    return x.select("column_name", r6("accuracy").alias("accuracy"), r6(rate).alias("sample_rate"))


@query
def accuracy_hll_precision(spark, d):
    s = load_sales(spark, d)
    r = with_scalars(s.agg(F.count_distinct("user_id").alias("distinct_users")),
                     sketches.hll_sweep(s, "user_id", HLL_PRECISIONS))
    x = r.withColumn("accuracy", F.explode(F.array(*[F.lit(a) for a in ACCURACY_LEVELS])))
    p = bounds.accuracy_to_hll_precision("accuracy")
    est = F.coalesce(*[F.when(p == q, F.col(f"e{q}")) for q in HLL_PRECISIONS])
    err = bounds.hll_error_pct(bounds.accuracy_to_hll_precision_sql("accuracy"))
    return x.select(r6("accuracy").alias("accuracy"), p.cast("bigint").alias("precision"),
                    r6(err).alias("error_pct"), "distinct_users",
                    (F.abs(est - F.col("distinct_users")) <= 3 * err / 100 * F.col("distinct_users"))
                    .alias("within_tolerance"))


@query
def achieved_accuracy(spark, d):
    s = _sales(spark, d)
    est = stratified.stratified_aggregate(s, "region", [CNT, SUM], STRAT_RATE)
    ex = exact_aggregate(load_sales(spark, d), [CNT, SUM], ["region"])
    j = est.select("region", F.col("cnt").alias("est_cnt"), F.col("total_revenue").alias("est_sum")) \
        .join(ex, "region")
    return j.select("region", "cnt", r6("total_revenue").alias("total_revenue"),
                    r6(bounds.achieved_accuracy("est_cnt", "cnt")).alias("count_accuracy"),
                    r6(bounds.achieved_accuracy("est_sum", "total_revenue")).alias("sum_accuracy"))


# ======================================================================== R
UNIFIED_AGGS = [CNT, SUM, AVG]


def _unified(df: DataFrame, group_by=()) -> DataFrame:
    cols = [*group_by]
    for _, _, name in UNIFIED_AGGS:
        cols += [r6(name).alias(name), r6(f"{name}_error_pct").alias(f"{name}_error_pct")]
    cols += ["strategy", r6("sample_rate").alias("sample_rate")]
    extra = [c for c in df.columns if c == "accuracy_target"]
    return df.select(*cols, *[r6(c).alias(c) for c in extra])


@query
def approx_aggregate_q(spark, d):
    st, s = _built(spark, d)
    return _unified(approx_aggregate(s, UNIFIED_AGGS, accuracy=0.95, table="sales", store=st))


@query
def approx_aggregate_filtered(spark, d):
    """Under a selective filter the answer keeps the target or is exact."""
    st, s = _built(spark, d)
    res = approx_aggregate(s, UNIFIED_AGGS, accuracy=0.90, where=F.col("user_id") < 75, table="sales", store=st)
    return _unified(res)


@query
def approx_aggregate_filtered_sum(spark, d):
    """A filter that 2 % of the rows pass, answered from stored strata where the margin of
    the filtered SUM keeps the target, else exactly."""
    ev = read_table(spark, d, "events")
    st = _store(spark, d, "event_types", lambda st: st.build_stratified(ev, "events", "event_type", "event_id", 0.25))
    parts = [approx_aggregate(ev, [("sum", "value", "total")], ["event_type"], accuracy=a, table="events",
                              where="user_id % 50 = 7", store=st).withColumn("accuracy_target", F.lit(a))
             for a in (0.2, 0.99)]
    return parts[0].unionByName(parts[1]).select(
        "event_type", r6("total").alias("total"), r6("total_error_pct").alias("total_error_pct"), "strategy",
        "accuracy_target")


@query
def approx_aggregate_rare_group(spark, d):
    """Eight even groups and one of four rows: an answer from a tier has all of them, or is
    no tier's, with and without a filter; without a list of the groups no tier is asked."""
    s = _sales(spark, d).withColumn("grp", F.when(F.col("event_id") < 4, F.lit("rare")).otherwise(
        F.concat(F.lit("g"), F.col("event_id") % 8)))
    stores = [_store(spark, d, f"rare-{len(k)}", lambda st: st.build_tiers(s, "sales", "event_id", known_groups=k))
              for k in ([["grp"]], [])]
    parts = []
    for st, listed in zip(stores, (True, False)):
        for a in (0.2, 0.95):
            for name, where in (("all", None), ("most", "amount > 20"), ("few", "event_id >= 4")):
                res = approx_aggregate(s, [CNT], ["grp"], accuracy=a, table="sales", store=st, where=where)
                parts.append(res.select(F.lit(listed).alias("listed"), F.lit(a).alias("accuracy_target"),
                                        F.lit(name).alias("filter"), "grp", "cnt", r6("cnt_error_pct").alias("cnt_error_pct"),
                                        "strategy"))
    return reduce(DataFrame.unionByName, parts)


@query
def approx_aggregate_grouped(spark, d):
    ev = read_table(spark, d, "events")
    aggs = [("count", "*", "cnt"), ("sum", "value", "total_revenue"), ("avg", "value", "avg_amount")]
    res = approx_aggregate(ev, aggs, ["event_type"], accuracy=0.95, key="event_id",
                           hash_method="md5", runtime_sampling=True)
    return _unified(res, ["event_type"])


@query
def approx_aggregate_skewed(spark, d):
    res = approx_aggregate(_sales(spark, d), UNIFIED_AGGS, ["region"], accuracy=0.95,
                           runtime_sampling=True)
    return _unified(res, ["region"])


@query
def approx_aggregate_small(spark, d):
    res = approx_aggregate(_sales(spark, d), UNIFIED_AGGS, ["region"], accuracy=0.95,
                           small_table_rows=100_000, runtime_sampling=True)
    return _unified(res, ["region"])


@query
def approx_aggregate_default(spark, d):
    """Without a stored sample the answer is exact, for a runtime sample reads the same."""
    return _unified(approx_aggregate(_sales(spark, d), UNIFIED_AGGS, ["region"], accuracy=0.95), ["region"])


@query
def approx_aggregate_sketch(spark, d):
    """SUM, two percentiles and a distinct count in one pass; the plain aggregate exact, the
    others within three times their stated error."""
    s = load_sales(spark, d)
    aggs = [SUM, ("percentile", "amount", "p50", 0.5), ("percentile", "amount", "p95", 0.95),
            ("count_distinct", "user_id", "users")]
    res = approx_aggregate(s, aggs, accuracy=0.95)
    exact = exact_aggregate(s, aggs).select(*[F.col(n).alias(f"x_{n}") for n in ("p50", "p95", "users")])
    x = F.col("amount").cast("double")
    j = with_scalars(s, res.select("p50", "p95")).agg(*[
        (F.count_if(x <= F.col(n)) / F.count(x)).alias(f"le_{n}") for n in ("p50", "p95")],
        *[(F.count_if(x < F.col(n)) / F.count(x)).alias(f"lt_{n}") for n in ("p50", "p95")])
    k = with_scalars(res, exact, j)
    tol = {n: 3 * F.col(f"{n}_error_pct") / 100 for n in ("p50", "p95", "users")}
    return k.select(r6("total_revenue").alias("total_revenue"), r6("x_p50").alias("p50"), r6("x_p95").alias("p95"),
                    F.col("x_users").alias("users"), "strategy", *[
        ((F.col(f"le_{n}") >= p - tol[n]) & (F.col(f"lt_{n}") <= p + tol[n])).alias(f"{n}_within")
        for n, p in (("p50", 0.5), ("p95", 0.95))],
        (F.abs(F.col("users") - F.col("x_users")) <= tol["users"] * F.col("x_users")).alias("users_within"))


@query
def compare_exact_approx_q(spark, d):
    res = compare_exact_approx(_sales(spark, d), [CNT, SUM], ["region"], accuracy=0.95,
                               runtime_sampling=True)
    cols = ["region"]
    for n in ("cnt", "total_revenue"):
        cols += [r6(f"{p}_{n}").alias(f"{p}_{n}") for p in ("exact", "approx", "rel_error", "accuracy")]
    return res.select(*cols, "strategy", r6("sample_rate").alias("sample_rate"))


@query
def compare_strategies_q(spark, d):
    st, s = _built(spark, d)
    res = compare_strategies(s, [CNT, SUM], ["region"], rate=UNIFORM_RATE, key="event_id",
                             table="sales", store=st)
    cols = ["strategy", "supported", "region"]
    for n in ("cnt", "total_revenue"):
        cols += [r6(f"{p}_{n}").alias(f"{p}_{n}") for p in ("exact", "approx", "rel_error")]
    return res.select(*cols, r6("sample_rate").alias("sample_rate"))


@query
def accuracy_sweep_q(spark, d):
    st, s = _built(spark, d)
    res = accuracy_sweep(s, UNIFIED_AGGS, table="sales", store=st)
    return _unified(res)


# keys as named in the inventory
for _k, _v in list(QUERIES.items()):
    if _k.endswith("_q"):
        QUERIES[_k[:-2]] = QUERIES.pop(_k)
