"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each string runs on DuckDB with the driver's tables registered as views
(``events``, ``lineitem``, ``orders``, ...). The skewed ``sales`` table and
its row hash are re-derived in SQL, so every sample here is drawn
independently of the Spark code. Rates are written as DOUBLE (a bare
``0.1`` is DECIMAL in SQL) and doubles are rounded to 6 decimals, as on the
Spark side.
"""

from __future__ import annotations

from roughcut.functions.hashing import HASH_SPACE, threshold
from roughcut.operators.bootstrap import poisson_thresholds
from roughcut.operators.samples import ppm
from roughcut.operators.sketches import quantile_name

SALES = """sales AS (
  SELECT event_id, user_id,
         CASE WHEN event_id % 1000 < 900 THEN 'US'
              WHEN event_id % 1000 < 998 THEN 'UK'
              ELSE 'Antarctica' END AS region,
         CAST(value AS DECIMAL(10,2)) AS amount,
         ts AS date,
         CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR)), 1, 15)) AS BIGINT) AS h
  FROM events)"""

T1, T5, T10, T20 = (threshold(r) for r in (0.01, 0.05, 0.10, 0.20))
ACC = (0.85, 0.90, 0.95, 0.99)
PCTS = (0.25, 0.5, 0.75, 0.95, 0.99, 0.999)


def d(x: float) -> str:
    """A DOUBLE literal."""
    return f"CAST({x!r} AS DOUBLE)"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def w(*ctes: str) -> str:
    return "WITH " + ",\n".join([SALES, *ctes]) + "\n"


def fpc(N: str, n: str) -> str:
    return f"(CASE WHEN {N} > 1 THEN sqrt(({N} - {n}) / ({N} - 1)) ELSE 1.0 END)"


def count_bound(n: str, r: str, method: str = "proportion") -> dict[str, str]:
    N = f"CAST(floor({n} / {r}) AS BIGINT)"
    core = (f"sqrt({r} * (1.0 - {r}) / {n})" if method == "proportion"
            else f"sqrt((1.0 - {r}) / {n})")
    margin = f"(CASE WHEN {n} > 0 THEN 1.96 * {core} * {fpc(N, n)} END)"
    return {
        "estimated_total": f"(CASE WHEN {n} > 0 THEN {N} END)",
        "error_pct": f"round({margin} * 100, 2)",
        "ci_low": f"CAST(floor({N} * (1.0 - {margin})) AS BIGINT)",
        "ci_high": f"CAST(floor({N} * (1.0 + {margin})) AS BIGINT)",
    }


def sum_bound(s: str, sd: str, n: str, N: str) -> dict[str, str]:
    ok = f"({n} > 1 AND {N} > 1)"
    total = f"(CASE WHEN {n} > 0 THEN {s} * {N} / {n} END)"
    margin = f"(CASE WHEN {ok} THEN 1.96 * ({N} * ({sd} / sqrt({n})) * {fpc(N, n)}) END)"
    pct = f"(CASE WHEN {total} <> 0 THEN {margin} / {total} * 100 WHEN {ok} THEN 0.0 END)"
    return {
        "estimated_total": f"round({total}, 2)",
        "error_pct": f"round({pct}, 2)",
        "ci_low": f"round({total} - {margin}, 2)",
        "ci_high": f"round({total} + {margin}, 2)",
    }


def avg_sem(sd: str, n: str, N: str) -> str:
    return f"(CASE WHEN {n} > 1 AND {N} > 1 THEN ({sd} / sqrt({n})) * {fpc(N, n)} END)"


def strat_err(n: str, N: str) -> str:
    p = f"({n} / {N})"
    return f"round(CASE WHEN {n} > 0 THEN 1.96 * sqrt({p} * (1.0 - {p}) / {n}) * 100 END, 2)"


def hsql(cols: list[str]) -> str:
    if len(cols) == 1:
        return f"CAST(('0x' || substr(md5(CAST({cols[0]} AS VARCHAR)), 1, 15)) AS BIGINT)"
    keys = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), '\\N')" for c in cols)
    return f"CAST(('0x' || substr(md5({keys}), 1, 15)) AS BIGINT)"


def strata(rate_thr: int, name: str = "strata", src: str = "sales", g: str = "region") -> str:
    return f"""{name} AS (
  SELECT {g}, count(*) AS population_count,
         count(*) FILTER (WHERE h < {rate_thr}) AS below_count,
         min(h) AS min_h,
         CAST(greatest(count(*) FILTER (WHERE h < {rate_thr}), 1) AS BIGINT) AS sample_count
  FROM {src} GROUP BY {g})"""


def samp(rate_thr: int, name: str = "samp", st: str = "strata") -> str:
    return f"""{name} AS (
  SELECT s.* FROM sales s JOIN {st} t ON s.region IS NOT DISTINCT FROM t.region
  WHERE s.h < {rate_thr} OR (t.below_count = 0 AND s.h = t.min_h))"""


AVG_AMT = "CAST(sum(amount) AS DOUBLE) / count(amount)"
SUM_AMT = "CAST(sum(amount) AS DOUBLE)"

Q: dict[str, str] = {}

# ======================================================================== A
Q["scan_parquet"] = w() + f"SELECT event_id, user_id, region, {r6('amount')} AS amount, date FROM sales"
Q["gen_skewed_sales"] = w() + f"""SELECT region, count(*) AS rows, {r6('sum(amount)')} AS sum_amount,
  {r6('min(amount)')} AS min_amount, {r6('max(amount)')} AS max_amount,
  count(DISTINCT user_id) AS users FROM sales GROUP BY region"""
Q["parquet_roundtrip"] = w() + f"SELECT event_id, region, {r6('amount')} AS amount, h FROM sales"
Q["group_distribution"] = w() + f"""SELECT region, count(*) AS count,
  {r6('round(CAST(count(*) AS DOUBLE) * 100.0 / sum(count(*)) OVER (), 2)')} AS pct
FROM sales GROUP BY region"""

_PROFILE_COLS = [("event_id", "bigint", True), ("user_id", "bigint", True),
                 ("region", "string", False), ("amount", "decimal(10,2)", True),
                 ("date", "timestamp_ntz", False)]


def _profile_rows(extra: str = "", numeric_only: bool = False, with_meta: bool = True,
                  rounded: bool = True) -> str:
    parts = []
    rnd = r6 if rounded else (lambda x: f"CAST({x} AS DOUBLE)")
    for i, (c, t, num) in enumerate(_PROFILE_COLS):
        if numeric_only and not num:
            continue
        mean = rnd(f"avg({c})") if num else "CAST(NULL AS DOUBLE)"
        sd = rnd(f"stddev_samp({c})") if num else "CAST(NULL AS DOUBLE)"
        meta = (f"{i} AS ordinal, '{c}' AS column_name, '{t}' AS data_type, {str(num).upper()} AS is_numeric, "
                f"count(*) AS row_count, count(DISTINCT {c}) AS cardinality, ") if with_meta else \
            f"'{c}' AS column_name, "
        parts.append(f"SELECT {meta}{mean} AS mean, {sd} AS stddev{extra} FROM sales")
    return "\nUNION ALL ".join(parts)


Q["profile_snapshot"] = w() + "SELECT column_name, data_type, row_count, cardinality, mean, stddev, " \
    "TRUE AS expires_after_ttl FROM (" + _profile_rows() + ")"

# ======================================================================== B
Q["exact_count"] = w() + "SELECT count(*) AS cnt FROM sales"
Q["exact_avg"] = w() + f"SELECT {r6(AVG_AMT)} AS avg_amount FROM sales"
Q["exact_sum"] = w() + f"SELECT {r6(SUM_AMT)} AS total_revenue FROM sales"
Q["exact_multi_agg"] = w() + f"""SELECT count(*) AS cnt, {r6(AVG_AMT)} AS avg_amount,
  {r6(SUM_AMT)} AS total_revenue, {r6('min(amount)')} AS min_amount, {r6('max(amount)')} AS max_amount FROM sales"""
Q["exact_group_count"] = w() + "SELECT region, count(*) AS cnt FROM sales GROUP BY region"
Q["exact_group_stats"] = w() + f"""SELECT region, count(*) AS cnt, {r6(AVG_AMT)} AS avg_amount,
  {r6(SUM_AMT)} AS total_revenue FROM sales GROUP BY region"""
Q["exact_count_distinct"] = w() + "SELECT count(DISTINCT user_id) AS distinct_users FROM sales"
Q["exact_median"] = w() + f"SELECT {r6('median(CAST(amount AS DOUBLE))')} AS median_amount FROM sales"
Q["exact_p95"] = w() + f"SELECT {r6('quantile_cont(CAST(amount AS DOUBLE), 0.95)')} AS p95 FROM sales"
Q["exact_percentile_disc"] = w() + f"SELECT {r6('quantile_disc(amount, 0.95)')} AS p95_disc FROM sales"
_NARROWED = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
Q["exact_quantiles_narrowed"] = w("""nx AS (SELECT CASE WHEN event_id % 3 = 0 THEN 0.0
  WHEN event_id % 10 = 1 THEN CAST('nan' AS DOUBLE) ELSE CAST(amount AS DOUBLE) END AS x FROM sales)""",
  "nq AS (SELECT " + ", ".join(f"quantile_cont(x, {p}) AS q{i}" for i, p in enumerate(_NARROWED)) + " FROM nx)") + \
    "SELECT " + ", ".join(f"CASE WHEN isnan(q{i}) THEN -1.0 ELSE {r6(f'q{i}')} END AS q{i}"
                          for i in range(len(_NARROWED))) + " FROM nq"
Q["exact_quantiles_narrowed_grouped"] = w("""nx AS (SELECT region, CASE WHEN event_id % 3 = 0 THEN 0.0
  ELSE CAST(amount AS DOUBLE) END AS x FROM sales)""") + "SELECT region, " + ", ".join(
    f"{r6(f'quantile_cont(x, {p})')} AS q{i}" for i, p in enumerate(_NARROWED)) + " FROM nx GROUP BY region"
Q["exact_filter_numeric"] = w() + "SELECT count(*) AS cnt FROM sales WHERE amount > 50"
Q["exact_filter_equality"] = w() + f"SELECT count(*) AS cnt, {r6(AVG_AMT)} AS avg_amount FROM sales WHERE region = 'US'"
Q["exact_filter_group"] = w() + "SELECT region, count(*) AS cnt FROM sales WHERE amount > 50 GROUP BY region"

# ======================================================================== C
R10 = d(0.1)
Q["sample_uniform_rows"] = w() + f"SELECT event_id, region, {r6('amount')} AS amount, h FROM sales WHERE h < {T10}"
Q["sample_native"] = w() + "SELECT count(*) AS population_rows, TRUE AS within_tolerance FROM sales"
Q["sample_agg"] = w() + f"""SELECT count(*) AS cnt, {r6(AVG_AMT)} AS avg_amount, {r6(SUM_AMT)} AS total_revenue,
  {r6('min(amount)')} AS min_amount, {r6('max(amount)')} AS max_amount FROM sales WHERE h < {T10}"""
Q["sample_scaled_count"] = w() + f"""SELECT count(*) AS cnt_sample,
  CAST(floor(count(*) / {R10}) AS BIGINT) AS cnt_estimate FROM sales WHERE h < {T10}"""
Q["sample_scaled_sum"] = w() + f"""SELECT {r6(SUM_AMT)} AS sum_sample,
  {r6(f'{SUM_AMT} / {R10}')} AS sum_estimate FROM sales WHERE h < {T10}"""
Q["sample_group"] = w() + f"""SELECT region, count(*) AS cnt, {r6(AVG_AMT)} AS avg_amount,
  {r6(SUM_AMT)} AS total_revenue FROM sales WHERE h < {T10} GROUP BY region"""
Q["sample_filter_group"] = w() + f"""SELECT region, count(*) AS cnt,
  CAST(floor(count(*) / {R10}) AS BIGINT) AS cnt_estimate
FROM sales WHERE h < {T10} AND amount > 50 GROUP BY region"""
_b = count_bound("c", R10)
Q["sample_count_error"] = w(f"g AS (SELECT region, count(*) AS c FROM sales WHERE h < {T10} GROUP BY region)") + \
    f"""SELECT region, c AS count_sample, CAST(floor(c / {R10}) AS BIGINT) AS estimated_total,
  {_b['error_pct']} AS error_pct, {_b['ci_low']} AS ci_low, {_b['ci_high']} AS ci_high FROM g"""

# ======================================================================== S
_ST1 = [strata(T1), samp(T1)]
Q["strata_distinct"] = w() + "SELECT DISTINCT region FROM sales"
Q["stratified_rows"] = w(*_ST1) + f"SELECT event_id, region, {r6('amount')} AS amount, h FROM samp"
Q["strata_population"] = w(strata(T1)) + \
    "SELECT region, population_count, below_count, sample_count, min_h FROM strata"


def _strat_agg(body_cols: str, where: str = "", thr: int = T1) -> str:
    """Estimates per stratum; under a filter every stratum stays."""
    src, ctes = "samp", [strata(thr), samp(thr)]
    join = "strata t LEFT JOIN a" if where else "a JOIN strata t"
    return w(*ctes, f"""a AS (SELECT region, count(*) AS cnt_s, {SUM_AMT} AS sum_s,
    {AVG_AMT} AS avg_s, CAST(min(amount) AS DOUBLE) AS min_s, CAST(max(amount) AS DOUBLE) AS max_s
  FROM {src} {where} GROUP BY region)""") + f"SELECT {body_cols} FROM {join} ON a.region = t.region"


def _wilson(v: str, n: str, N: str) -> tuple[str, str, str]:
    """Interval and relative error of a filtered stratum count: Wilson's, cut to what the
    sample proves (the matches and the misses it holds)."""
    p = f"(CAST({v} AS DOUBLE) / {n})"
    centre = f"(({p} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}))"
    half = f"(1.96 / (1 + 3.8416 / {n}) * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n})))"
    low = f"greatest({v}, CAST(floor({N} * ({centre} - {half})) AS BIGINT))"
    high = f"least({N} - {n} + {v}, CAST(ceil({N} * ({centre} + {half})) AS BIGINT))"
    est = f"(CAST({v} AS DOUBLE) * {N} / {n})"
    return low, high, f"round(CASE WHEN {v} > 0 THEN greatest({high} - {est}, {est} - {low}) / {est} * 100 END, 2)"


_CNT_EST = "CAST(floor(a.cnt_s * t.population_count / t.sample_count) AS BIGINT)"
_SUM_EST = "a.sum_s * t.population_count / t.sample_count"
_ERR = strat_err("t.sample_count", "t.population_count")
Q["stratified_count"] = _strat_agg(
    f"a.region, {_CNT_EST} AS cnt, a.cnt_s AS cnt_sample, t.sample_count, t.population_count, {_ERR} AS error_pct")
Q["stratified_sum"] = _strat_agg(
    f"a.region, {r6(_SUM_EST)} AS total_revenue, {r6('a.sum_s')} AS total_revenue_sample")
Q["stratified_avg"] = _strat_agg(f"a.region, {r6('a.avg_s')} AS avg_amount")
Q["stratified_minmax"] = _strat_agg(f"a.region, {r6('a.min_s')} AS min_amount, {r6('a.max_s')} AS max_amount")
Q["stratified_error"] = w(strata(T1)) + f"""SELECT region, sample_count, population_count,
  {strat_err('sample_count', 'population_count')} AS error_pct FROM strata"""
_sbd = sum_bound("a.sum_s", "a.sd_s", "CAST(t.sample_count AS DOUBLE)", "CAST(t.population_count AS DOUBLE)")
_sem_b = avg_sem("a.sd_s", "CAST(t.sample_count AS DOUBLE)", "CAST(t.population_count AS DOUBLE)")
Q["stratified_bounds"] = w(strata(T10), samp(T10), f"""a AS (SELECT region, {SUM_AMT} AS sum_s, {AVG_AMT} AS avg_s,
    stddev_samp(amount) FILTER (WHERE h < {T10}) AS sd_s FROM samp GROUP BY region)""") + f"""SELECT a.region,
  {r6(_SUM_EST)} AS total_revenue, {_sbd['ci_low']} AS total_revenue_ci_low,
  {_sbd['ci_high']} AS total_revenue_ci_high, {r6('a.avg_s')} AS avg_amount,
  round(a.avg_s - round(1.96 * {_sem_b}, 4), 4) AS avg_amount_ci_low,
  round(a.avg_s + round(1.96 * {_sem_b}, 4), 4) AS avg_amount_ci_high, t.sample_count
FROM a JOIN strata t ON a.region = t.region"""
_V = "coalesce(a.cnt_s, 0)"
_W_LOW, _W_HIGH, _W_ERR = _wilson(_V, "t.sample_count", "t.population_count")
_FILTERED = (f"t.region, CAST(floor({_V} * t.population_count / t.sample_count) AS BIGINT) AS cnt, "
             f"{_V} AS cnt_sample, {r6(f'coalesce({_SUM_EST}, 0)')} AS total_revenue, "
             f"{_W_LOW} AS cnt_ci_low, {_W_HIGH} AS cnt_ci_high")
Q["stratified_filtered"] = _strat_agg(
    f"{_FILTERED}, t.sample_count, t.population_count, {_W_ERR} AS cnt_error_pct", where="WHERE amount > 50")
Q["stratified_filtered_rare"] = _strat_agg(_FILTERED, where="WHERE user_id < 2")



def domain_sum(s: str, sd: str, k: str, n: str, N: str, lo: str, hi: str) -> dict[str, str]:
    """Filtered SUM of a stratum: the spread is that of the value times whether the row matches."""
    spread = (f"(CASE WHEN {n} <= 1 THEN NULL WHEN {k} = {n} THEN {sd} WHEN {k} > 0 THEN "
              f"sqrt((coalesce({sd} * {sd} * ({k} - 1), 0.0) + ({s} / {k}) * ({s} / {k}) * {k} * ({n} - {k}) / {n}) "
              f"/ ({n} - 1)) ELSE 0.0 END)")
    b = sum_bound(s, spread, n, N)
    most = _wilson("0", n, N)[1]
    none, whole = f"({k} = 0 AND {n} < {N})", f"{n} >= {N}"
    return {"error_pct": f"CASE WHEN {none} THEN NULL WHEN {whole} THEN 0.0 ELSE abs({b['error_pct']}) END",
            "ci_low": f"CASE WHEN {none} THEN round({most} * least(coalesce({lo}, 0.0), 0.0), 2) "
                      f"WHEN {whole} THEN round({s}, 2) ELSE {b['ci_low']} END",
            "ci_high": f"CASE WHEN {none} THEN round({most} * greatest(coalesce({hi}, 0.0), 0.0), 2) "
                       f"WHEN {whole} THEN round({s}, 2) ELSE {b['ci_high']} END"}


Q["sample_blocks"] = w() + f"""SELECT count(*) AS cnt, {r6(SUM_AMT)} AS total_revenue, {r6(AVG_AMT)} AS avg_amount,
  12 AS sample_blocks, 48 AS blocks, TRUE AS cnt_within, TRUE AS total_revenue_within, TRUE AS avg_amount_within,
  12 AS files_read FROM sales"""

_KEYLESS = """nk AS (SELECT CASE WHEN event_id % 2 = 0 AND event_id % 97 <> 0 THEN event_id END AS k,
  CASE WHEN event_id % 97 = 0 THEN 'keyless' ELSE region END AS stratum, amount FROM sales)"""
Q["sample_null_keys"] = w(_KEYLESS) + f"""SELECT stratum, count(*) AS cnt, {r6(SUM_AMT)} AS total_revenue
FROM nk GROUP BY stratum"""
Q["stratified_null_keys"] = w(_KEYLESS, r"""nh AS (SELECT *,
  CAST(('0x' || substr(md5(coalesce(CAST(k AS VARCHAR), '\N')), 1, 15)) AS BIGINT) AS kh FROM nk)""") + f"""SELECT stratum,
  count(*) AS cnt, CAST(greatest(count(*) FILTER (WHERE kh < {T1}), 1) AS BIGINT) AS sample_count,
  count(*) AS population_count, TRUE AS rows_agree FROM nh GROUP BY stratum"""

_LI_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
Q["stratified_count_lineitem"] = f"""WITH li AS (SELECT *, {hsql(_LI_KEY)} AS h FROM lineitem),
st AS (SELECT l_returnflag, l_linestatus, count(*) AS population_count,
         count(*) FILTER (WHERE h < {T1}) AS below_count, min(h) AS min_h,
         CAST(greatest(count(*) FILTER (WHERE h < {T1}), 1) AS BIGINT) AS sample_count
       FROM li GROUP BY l_returnflag, l_linestatus),
sp AS (SELECT li.* FROM li JOIN st ON li.l_returnflag IS NOT DISTINCT FROM st.l_returnflag
         AND li.l_linestatus IS NOT DISTINCT FROM st.l_linestatus
       WHERE li.h < {T1} OR (st.below_count = 0 AND li.h = st.min_h)),
a AS (SELECT l_returnflag, l_linestatus, count(*) AS c, CAST(sum(l_quantity) AS DOUBLE) AS s
      FROM sp GROUP BY l_returnflag, l_linestatus)
SELECT a.l_returnflag, a.l_linestatus,
  CAST(floor(a.c * st.population_count / st.sample_count) AS BIGINT) AS cnt,
  {r6('a.s * st.population_count / st.sample_count')} AS sum_qty,
  st.sample_count, st.population_count, {strat_err('st.sample_count', 'st.population_count')} AS error_pct
FROM a JOIN st ON a.l_returnflag IS NOT DISTINCT FROM st.l_returnflag
  AND a.l_linestatus IS NOT DISTINCT FROM st.l_linestatus"""

# the stratum's rows under the threshold, or its forced row; those that match have a value
_DS = domain_sum("a.s", "a.sd", "a.k", "a.n", "a.pop", "a.lo", "a.hi")
_DS_SEM = avg_sem("a.sd", "a.k", "(a.k * a.pop / a.n)")
Q["stratified_filtered_sum"] = f"""WITH li AS (SELECT *, {hsql(_LI_KEY)} AS h, l_partkey % 50 = 7 AS m FROM lineitem),
st AS (SELECT l_returnflag AS rf, l_linestatus AS ls, count(*) AS pop, min(h) AS mh,
         count(*) FILTER (WHERE h < {T10}) AS below, CAST(min(l_quantity) AS DOUBLE) AS lo,
         CAST(max(l_quantity) AS DOUBLE) AS hi FROM li GROUP BY ALL),
a AS (SELECT rf, ls, pop, lo, hi, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE m) AS DOUBLE) AS k,
        CAST(coalesce(sum(l_quantity) FILTER (WHERE m), 0) AS DOUBLE) AS s, stddev_samp(l_quantity) FILTER (WHERE m) AS sd
      FROM li JOIN st ON l_returnflag = rf AND l_linestatus = ls
      WHERE h < {T10} OR (below = 0 AND h = mh) GROUP BY ALL)
SELECT rf AS l_returnflag, ls AS l_linestatus, {r6('s * pop / n')} AS sum_qty, {r6(_DS['ci_low'])} AS sum_qty_ci_low,
  {r6(_DS['ci_high'])} AS sum_qty_ci_high, {r6(_DS['error_pct'])} AS sum_qty_error_pct,
  {r6('CASE WHEN k > 0 THEN s / k END')} AS avg_qty,
  {r6(f'round(CASE WHEN k > 0 THEN s / k END - round(1.96 * {_DS_SEM}, 4), 4)')} AS avg_qty_ci_low,
  {r6(f'round(CASE WHEN k > 0 THEN s / k END + round(1.96 * {_DS_SEM}, 4), 4)')} AS avg_qty_ci_high
FROM a"""

_TP5 = threshold(0.005)
Q["sample_incremental"] = w(strata(_TP5), samp(_TP5)) + f"""SELECT event_id, sample, (SELECT CAST(sum(population_count) AS BIGINT) FROM strata) AS population,
  (SELECT CAST(sum(sample_count) AS BIGINT) FROM strata) AS strata_rows, 3 AS files_read
FROM (SELECT event_id, 'tier' AS sample FROM sales WHERE h < {T20} UNION ALL SELECT event_id, 'strata' FROM samp)"""


def _priority(weight: str, k: int = 400) -> str:
    """The k rows of the largest priorities, and the first priority left out."""
    return f"""pr AS (SELECT *, {weight} / ((CAST(h AS DOUBLE) + 0.5) / {d(float(HASH_SPACE))}) AS priority, {weight} AS weight
  FROM (SELECT *, {hsql(_LI_KEY)} AS h FROM lineitem) WHERE {weight} > 0),
rk AS (SELECT *, row_number() OVER (ORDER BY priority DESC, h) AS rn FROM pr),
tau AS (SELECT priority AS tau FROM rk WHERE rn = {k} + 1),
ps AS (SELECT rk.*, least(1.0, weight / tau) AS p FROM rk, tau WHERE rn <= {k})"""


Q["sample_priority"] = f"""WITH {_priority("(CAST(l_extendedprice AS DOUBLE) ** 2 * CAST(l_linenumber > 3 AS INT))")}
SELECT {", ".join(_LI_KEY)}, {r6('p')} AS inclusion FROM ps"""


def _ht(x: str, est: str, margin: str) -> str:
    return (f"round({est}, 2) AS {x}, round({est} - {margin}, 2) AS {x}_ci_low, round({est} + {margin}, 2) AS {x}_ci_high, "
            f"round(round({margin} / abs({est}) * 100, 4), 2) AS {x}_error_pct")


_PV = "(1.0 - p) / (p * p)"
Q["priority_sum"] = f"""WITH {_priority("CAST(l_extendedprice AS DOUBLE)")},
a AS (SELECT l_returnflag, count(*) AS sample_rows, sum(l_extendedprice / p) AS s,
        sum(CAST(l_extendedprice AS DOUBLE) ** 2 * {_PV}) AS sv, sum(1.0 / p) AS c, sum({_PV}) AS cv,
        sum(l_quantity / p) AS t, sum(CAST(l_quantity AS DOUBLE) ** 2 * {_PV}) AS tv, sum(l_quantity * {_PV}) AS tc
      FROM ps WHERE l_discount > 0.02 GROUP BY l_returnflag),
b AS (SELECT *, t / c AS av FROM a)
SELECT l_returnflag, {_ht('total', 's', '(1.96 * sqrt(sv))')}, {_ht('cnt', 'c', '(1.96 * sqrt(cv))')},
  {_ht('qty', 'av', '(1.96 * sqrt(tv - 2 * av * tc + av * av * cv) / c)')}, sample_rows FROM b"""

# the mean of all, the mean of those below the 32nd of an octave that holds the 61st farthest, the 61st farthest
_OUTLIERS = """e AS (SELECT *, value * value * value AS cost FROM events),
o AS (SELECT e.*, floor(log2(nullif(abs(cost - c0), 0)) * 32) AS part FROM e, (SELECT avg(cost) AS c0 FROM e)),
k1 AS (SELECT part AS cut_part FROM (SELECT part, sum(count(*)) OVER (ORDER BY part DESC) AS upto FROM o WHERE part IS NOT NULL GROUP BY part)
  WHERE upto > 60 ORDER BY part DESC LIMIT 1),
c1 AS (SELECT avg(cost) AS center FROM o, k1 WHERE part < cut_part OR (part IS NULL AND cost IS NOT NULL)),
f AS (SELECT e.*, abs(cost - center) AS far FROM e, c1),
t AS (SELECT far AS cut FROM f ORDER BY far DESC NULLS LAST LIMIT 1 OFFSET 60),
x AS (SELECT f.*, coalesce(far > cut, false) AS extreme FROM f, t)"""
Q["outlier_rows"] = f"WITH {_OUTLIERS} SELECT event_id, {r6('cost')} AS cost FROM x WHERE extreme"


def _rest(yy: str, y: str) -> str:
    """Margin of a total over the n sampled of the other rows."""
    return f"(1.96 * pop * sqrt(greatest({yy} - {y} * {y} / n, 0) / (n - 1) / n * (1.0 - n / CAST(pop AS DOUBLE))))"


Q["outlier_sum"] = f"""WITH {_OUTLIERS},
m AS (SELECT count(*) FILTER (WHERE NOT extreme) AS pop, count(*) FILTER (WHERE NOT extreme AND {hsql(['event_id'])} < {T10}) AS n FROM x),
g AS (SELECT event_type, any_value(m.pop) AS pop, any_value(m.n) AS n, count(*) FILTER (WHERE extreme) AS ic, count(*) FILTER (WHERE NOT extreme) AS rc,
    coalesce(sum(cost) FILTER (WHERE extreme), 0) AS it, coalesce(sum(cost) FILTER (WHERE NOT extreme), 0) AS rt,
    coalesce(sum(cost * cost) FILTER (WHERE NOT extreme), 0) AS ryy
  FROM x, m WHERE user_id % 4 < 3 AND (extreme OR {hsql(['event_id'])} < {T10}) GROUP BY event_type),
s AS (SELECT *, it + rt * pop / n AS t, ic + rc * pop / CAST(n AS DOUBLE) AS c FROM g),
a AS (SELECT *, t / c AS av FROM s)
SELECT event_type, {_ht('total', 't', _rest('ryy', 'rt'))}, {_ht('cnt', 'c', _rest('rc', 'CAST(rc AS DOUBLE)'))},
  {_ht('mean', 'av', f"({_rest('(ryy - 2 * av * rt + av * av * rc)', '(rt - av * rc)')} / c)")}, ic AS index_rows, rc AS sample_rows FROM a"""

_POISSON = " ".join(f"WHEN u < {t} THEN {k}" for k, t in enumerate(poisson_thresholds()))


def _boot(x: str, est: str, reps: str) -> str:
    """Interval of 100 replicates at 95 % with deviations of a 10 % sample."""
    v = f"list_sort({reps})"
    low = f"({est} + sqrt(0.9) * ({v}[2] + 0.525 * ({v}[3] - {v}[2]) - {est}))"
    high = f"({est} + sqrt(0.9) * ({v}[99] - 0.525 * ({v}[99] - {v}[98]) - {est}))"
    return (f"round({est}, 2) AS {x}, round({low}, 2) AS {x}_ci_low, round({high}, 2) AS {x}_ci_high, "
            f"round(round(greatest({high} - {est}, {est} - {low}) / abs({est}) * 100, 4), 2) AS {x}_error_pct")


Q["bootstrap_bounds"] = f"""WITH s AS (SELECT l_returnflag, CAST(l_extendedprice AS DOUBLE) AS y,
    CAST(100 * l_extendedprice * l_discount AS DOUBLE) AS z, {hsql(['l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber'])} AS h
  FROM lineitem),
u AS (SELECT s.*, b, (CAST('0x' || substr(md5(CAST(h AS VARCHAR) || ':' || CAST(b // 8 AS VARCHAR)), CAST(1 + 15 * ((b // 4) % 2) AS INTEGER), 15) AS BIGINT)
    >> CAST(15 * (b % 4) AS INTEGER)) & 32767 AS u FROM s, range(100) AS r(b) WHERE h < {T10}),
w AS (SELECT *, CASE {_POISSON} ELSE 8 END AS w FROM u),
p AS (SELECT l_returnflag, b, sum(w) / 0.1::DOUBLE AS c, sum(w * y) / 0.1::DOUBLE AS t, sum(w * z) / sum(w * y) AS r FROM w GROUP BY ALL),
l AS (SELECT l_returnflag, list(c) AS cs, list(t) AS ts, list(r) AS rs FROM p GROUP BY ALL),
e AS (SELECT l_returnflag, count(*) AS n, count(*) / 0.1::DOUBLE AS c, sum(y) / 0.1::DOUBLE AS t, sum(z) / sum(y) AS r FROM s WHERE h < {T10} GROUP BY ALL)
SELECT e.l_returnflag, {_boot('cnt', 'c', 'cs')}, {_boot('total', 't', 'ts')}, {_boot('discount_pct', 'r', 'rs')},
  n AS sample_rows FROM e JOIN l ON e.l_returnflag IS NOT DISTINCT FROM l.l_returnflag"""

Q["bootstrap_median"] = f"""SELECT l_returnflag, {r6('quantile_cont(l_extendedprice, 0.5)')} AS exact_med,
  {r6('quantile_cont(l_extendedprice, 0.9)')} AS exact_p90, TRUE AS med_within, TRUE AS med_bounded, TRUE AS p90_within,
  TRUE AS p90_bounded FROM lineitem GROUP BY l_returnflag"""

Q["distinct_sets"] = """WITH p AS (SELECT user_id * 100000 + CAST(floor(value) AS BIGINT) AS pair, bool_or(event_type = 'click') AS c,
  bool_or(event_type = 'error') AS e, bool_or(event_type = 'view') AS v FROM events GROUP BY 1)
SELECT 'both' AS set_name, count(*) FILTER (WHERE c AND e) AS exact, TRUE AS within FROM p UNION ALL
SELECT 'either', count(*) FILTER (WHERE c OR e), TRUE FROM p UNION ALL
SELECT 'click_only', count(*) FILTER (WHERE c AND NOT e AND NOT v), TRUE FROM p UNION ALL
SELECT 'unknown', 0, TRUE"""

_MID = """m AS (SELECT max(event_id) + 1 AS n FROM events),
x AS (SELECT s.* FROM sales s, m WHERE event_id BETWEEN n // 5 AND n - n // 3)"""
Q["summary_range"] = w(_MID) + f"""SELECT region, {r6('count(*)')} AS cnt, round(CAST(sum(amount) AS DOUBLE), 2) AS total,
  {r6(AVG_AMT)} AS mean, 0.0::DOUBLE AS error_pct, TRUE AS ends_only, TRUE AS most_from_summaries FROM x GROUP BY region"""
Q["summary_sampled"] = w(_MID) + f"""SELECT count(*) AS exact_cnt, {r6('sum(amount)')} AS exact_total, TRUE AS cnt_within,
  TRUE AS total_within, TRUE AS drawn FROM x"""

Q["universe_join"] = f"""WITH k AS (SELECT o_orderpriority, l_orderkey, count(*) AS c, sum(CAST(l_extendedprice AS DOUBLE)) AS t
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 10 AND {hsql(['o_orderkey'])} < {T10} GROUP BY ALL),
a AS (SELECT o_orderpriority, count(*) AS sample_keys, sum(c) AS n, sum(t) AS t, sum(c * c) AS cc, sum(t * t) AS tt,
        sum(c * t) AS ct, sum(t) / sum(c) AS av FROM k GROUP BY o_orderpriority)
SELECT o_orderpriority, {_ht('cnt', '(n / 0.1)', '(1.96 * sqrt(90.0 * cc))')}, {_ht('total', '(t / 0.1)', '(1.96 * sqrt(90.0 * tt))')},
  {_ht('price', 'av', '(1.96 * sqrt(90.0 * (tt - 2 * av * ct + av * av * cc)) / (n / 0.1))')}, sample_keys FROM a"""

Q["allocated_strata"] = """SELECT CAST(floor(log2(greatest(l_partkey, 1))) AS INTEGER) AS grp, count(*) AS population_count,
  TRUE AS budget_kept, TRUE AS worst_is_less, TRUE AS within FROM lineitem GROUP BY 1"""

Q["stratified_documents_lang"] = f"""WITH dc AS (SELECT doc_id, lang, n_chars, {hsql(['doc_id'])} AS h FROM documents),
st AS (SELECT lang, count(*) AS population_count, count(*) FILTER (WHERE h < {T10}) AS below_count,
         min(h) AS min_h, CAST(greatest(count(*) FILTER (WHERE h < {T10}), 1) AS BIGINT) AS sample_count
       FROM dc GROUP BY lang),
sp AS (SELECT dc.* FROM dc JOIN st ON dc.lang IS NOT DISTINCT FROM st.lang
       WHERE dc.h < {T10} OR (st.below_count = 0 AND dc.h = st.min_h)),
a AS (SELECT lang, count(*) AS c, CAST(sum(n_chars) AS DOUBLE) AS s,
        CAST(sum(n_chars) AS DOUBLE) / count(n_chars) AS av FROM sp GROUP BY lang)
SELECT a.lang, CAST(floor(a.c * st.population_count / st.sample_count) AS BIGINT) AS docs,
  {r6('a.av')} AS avg_chars, {r6('a.s * st.population_count / st.sample_count')} AS total_chars,
  st.sample_count, st.population_count, {strat_err('st.sample_count', 'st.population_count')} AS error_pct
FROM a JOIN st ON a.lang IS NOT DISTINCT FROM st.lang"""

# ======================================================================== E
_TIERS = ((0.01, T1, "1pct"), (0.10, T10, "10pct"), (0.20, T20, "20pct"))
_SIZES = f"""sz AS (SELECT count(*) AS n_all,
  count(*) FILTER (WHERE h < {T1}) AS n1, count(*) FILTER (WHERE h < {T10}) AS n10,
  count(*) FILTER (WHERE h < {T20}) AS n20 FROM sales)"""
Q["sample_tiers_build"] = w() + f"""SELECT event_id, region, {r6('amount')} AS amount, h,
  CASE WHEN h < {T1} THEN {ppm(0.01)} WHEN h < {T10} THEN {ppm(0.10)} ELSE {ppm(0.20)} END AS tier_ppm
FROM sales WHERE h < {T20}"""
Q["sample_stratified_build"] = w(strata(T10), samp(T10)) + \
    f"SELECT event_id, region, {r6('amount')} AS amount, h FROM samp"


def _registry_sql(strat: bool = True) -> str:
    rows = [f"SELECT 'sales' AS table_name, '{nm}' AS sample_type, {r6(d(r))} AS rate, "
            f"CAST(NULL AS VARCHAR) AS group_cols, {n} AS sample_rows, n_all AS population_rows, "
            f"n20 AS stored_rows, {r6(f'{n} / n_all')} AS realised_rate, "
            f"{r6('n20 / n_all')} AS storage_overhead FROM sz"
            for (r, _, nm), n in zip(_TIERS, ("n1", "n10", "n20"))]
    if strat:
        rows.append(f"SELECT 'sales', 'stratified', {r6(d(0.1))}, 'region', CAST(sum(sample_count) AS BIGINT), "
                    f"CAST(sum(population_count) AS BIGINT), CAST(sum(sample_count) AS BIGINT), "
                    f"{r6('sum(sample_count) / sum(population_count)')}, "
                    f"{r6('sum(sample_count) / sum(population_count)')} FROM strata")
    return w(_SIZES, strata(T10)) + "\nUNION ALL ".join(rows)


Q["sample_registry"] = _registry_sql()
Q["sample_refresh"] = _registry_sql()
Q["sample_rebuild_rates"] = w(f"""ev AS (SELECT count(*) AS n, count(*) FILTER (WHERE h < {T5}) AS n5,
  count(*) FILTER (WHERE h < {threshold(0.25)}) AS n25 FROM sales WHERE event_id % 2 = 0)""") + "\nUNION ALL ".join(
    f"SELECT '{nm}' AS sample_type, {r6(d(r))} AS rate, {c} AS sample_rows, n AS population_rows, "
    "n AS cnt_estimate FROM ev" for nm, r, c in (("5pct", 0.05, "n5"), ("25pct", 0.25, "n25")))
Q["profile_invalidate"] = "SELECT CAST(2 AS BIGINT) AS created, TRUE AS fresh_before, TRUE AS stale_after"
Q["sample_tier_choice"] = w(_SIZES) + "\nUNION ALL ".join(
    f"SELECT {r6(d(a))} AS accuracy, '{nm}' AS sample_type, {r6(d(r))} AS rate, {n} AS sample_rows FROM sz"
    for a, (r, nm, n) in zip(ACC, [(0.01, "1pct", "n1"), (0.1, "10pct", "n10"),
                                   (0.2, "20pct", "n20"), (0.2, "20pct", "n20")]))

_RR10 = "(CAST(sz.n10 AS DOUBLE) / sz.n_all)"
_mb = count_bound("a.c", _RR10)
Q["materialized_agg"] = w(_SIZES, f"""a AS (SELECT count(*) AS c, {SUM_AMT} AS s, {AVG_AMT} AS av
  FROM sales WHERE h < {T10})""") + f"""SELECT CAST(floor(a.c * sz.n_all / sz.n10) AS BIGINT) AS cnt,
  a.c AS cnt_sample, {_mb['error_pct']} AS cnt_error_pct,
  {r6('a.s * sz.n_all / sz.n10')} AS total_revenue, {r6('a.av')} AS avg_amount,
  {r6(_RR10)} AS sample_rate, '10pct' AS sample_type FROM a, sz"""
Q["materialized_group"] = _strat_agg(
    f"a.region, {_CNT_EST} AS cnt, a.cnt_s AS cnt_sample, {r6(_SUM_EST)} AS total_revenue, "
    f"t.sample_count, t.population_count, {_ERR} AS error_pct", thr=T10)
Q["materialized_filter"] = w(_SIZES, f"""a AS (SELECT count(*) AS c, {SUM_AMT} AS s
  FROM sales WHERE h < {T10} AND amount > 50)""") + f"""SELECT
  CAST(floor(a.c * sz.n_all / sz.n10) AS BIGINT) AS cnt, a.c AS cnt_sample,
  {r6('a.s * sz.n_all / sz.n10')} AS total_revenue, {r6(_RR10)} AS sample_rate FROM a, sz"""

# ======================================================================== F
Q["approx_distinct"] = w() + "SELECT count(DISTINCT user_id) AS distinct_users, TRUE AS within_tolerance FROM sales"
Q["approx_distinct_filtered"] = w() + \
    "SELECT count(DISTINCT user_id) AS distinct_users, TRUE AS within_tolerance FROM sales WHERE amount > 50"
Q["approx_distinct_keys"] = """SELECT count(DISTINCT l_orderkey) AS distinct_keys, TRUE AS within_0,
  TRUE AS within_1, TRUE AS within_2 FROM lineitem"""
Q["approx_distinct_grouped"] = w() + \
    "SELECT region, count(DISTINCT user_id) AS distinct_users, TRUE AS within_tolerance FROM sales GROUP BY region"
Q["approx_distinct_orders"] = """SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers,
  TRUE AS within_tolerance FROM orders GROUP BY o_orderstatus"""
Q["hll_distinct"] = Q["approx_distinct"]
Q["hll_precision_sweep"] = w("u AS (SELECT count(DISTINCT user_id) AS distinct_users FROM sales)") + \
    "\nUNION ALL ".join(
        f"SELECT CAST({p} AS BIGINT) AS precision, {r6(f'104.0 / sqrt(pow(2.0, {p}))')} AS error_pct, "
        "distinct_users, TRUE AS within_tolerance FROM u" for p in (10, 12, 14, 16))
Q["hll_merge"] = w() + """SELECT count(DISTINCT user_id) AS distinct_users, TRUE AS merge_agrees_with_direct,
  TRUE AS within_tolerance FROM sales"""


# ======================================================================== Q
def _quantiles(probs, src: str = "sales", where: str = "", group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return "\nUNION ALL ".join(
        f"SELECT {g}'{quantile_name(p)}' AS quantile, {r6(d(p))} AS p, "
        f"{r6(f'quantile_cont(CAST(amount AS DOUBLE), {p!r})')} AS exact_value, "
        f"TRUE AS within_rank_tolerance FROM {src} {where}{gb}" for p in probs)


Q["approx_median"] = w() + _quantiles([0.5])
Q["approx_percentiles"] = w() + _quantiles(PCTS)
Q["kll_quantile"] = w() + "SELECT *, CAST(0.005 AS DOUBLE) AS error_estimate FROM (" + _quantiles(PCTS) + ")"
Q["sampled_quantile"] = w() + _quantiles([0.5, 0.95])
Q["kll_merge"] = w() + _quantiles(PCTS)
Q["approx_median_grouped"] = w() + _quantiles([0.5], group="region")

# ======================================================================== P
Q["profile_table"] = w() + _profile_rows()
Q["profile_cardinality"] = w() + "SELECT column_name, cardinality, TRUE AS approx_within_tolerance FROM (" + \
    _profile_rows() + ")"
Q["profile_numeric"] = w() + _profile_rows(numeric_only=True, with_meta=False)
Q["profile_large_mean"] = w("lm AS (SELECT CAST(amount AS DOUBLE) + 1e9 AS x FROM sales)") + \
    "SELECT 'x' AS column_name, count(*) AS row_count, round(avg(x), 2) AS mean, round(stddev_samp(x), 3) AS stddev FROM lm"

_HIST = f"""b AS (SELECT min(CAST(amount AS DOUBLE)) AS lo, max(CAST(amount AS DOUBLE)) AS hi FROM sales),
binned AS (SELECT least(19, CAST(floor((CAST(amount AS DOUBLE) - lo) / ((hi - lo) / 20.0)) AS INTEGER)) AS bin
  FROM sales, b WHERE amount IS NOT NULL),
ids AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20)),
hist AS (SELECT ids.bin, CAST(count(binned.bin) AS BIGINT) AS count FROM ids LEFT JOIN binned ON ids.bin = binned.bin
  GROUP BY ids.bin)"""
Q["profile_histogram"] = w(_HIST) + f"""SELECT hist.bin, {r6('lo + hist.bin * ((hi - lo) / 20.0)')} AS bin_lo,
  {r6('lo + (hist.bin + 1) * ((hi - lo) / 20.0)')} AS bin_hi, hist.count FROM hist, b"""


def _gini(counts_cte: str, skewed: bool = False) -> str:
    sk = f", ({r6('g * n / (n - 1)')} > 0.6) AS skewed" if skewed else ""
    return w(counts_cte, """rk AS (SELECT CAST(c AS DOUBLE) AS c,
    CAST(row_number() OVER (ORDER BY c) AS DOUBLE) AS i FROM cnts),
gg AS (SELECT count(*) AS n, abs(2 * sum(i * c) / (count(*) * sum(c)) - (count(*) + 1.0) / count(*)) AS g
  FROM rk)""") + f"""SELECT CAST(n AS BIGINT) AS groups, {r6('g')} AS gini,
  {r6('CASE WHEN n > 1 THEN g * n / (n - 1) END')} AS gini_normalised{sk} FROM gg"""


Q["profile_gini"] = _gini(_HIST + ",\ncnts AS (SELECT count AS c FROM hist)")
Q["profile_gini_category"] = _gini("cnts AS (SELECT count(*) AS c FROM sales GROUP BY region)", skewed=True)
Q["profile_skew"] = w("""g AS (SELECT 'region' AS column_name, count(*) AS c FROM sales GROUP BY region
  UNION ALL SELECT 'user_id', count(*) FROM sales GROUP BY user_id)""",
                      """rk AS (SELECT column_name, CAST(c AS DOUBLE) AS c,
  CAST(row_number() OVER (PARTITION BY column_name ORDER BY c) AS DOUBLE) AS i FROM g)""",
                      """gg AS (SELECT column_name, count(*) AS n,
  abs(2 * sum(i * c) / (count(*) * sum(c)) - (count(*) + 1.0) / count(*)) AS g FROM rk GROUP BY column_name)""") + \
    f"""SELECT column_name, CAST(n AS BIGINT) AS groups, {r6('g')} AS gini,
  {r6('CASE WHEN n > 1 THEN g * n / (n - 1) END')} AS gini_normalised FROM gg"""
Q["heavy_values"] = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS value, count(*) AS count, "
    f"{r6('count(*) / (SELECT count(*) FROM events)')} AS share FROM events GROUP BY {c} HAVING count(*) >= 0.02 * (SELECT count(*) FROM events)"
    for c in ("event_type", "user_id", "event_id"))
Q["skew_interval"] = w("g AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS c FROM sales GROUP BY {c}"
                                                    for c in ("region", "user_id", "event_id")) + ")",
                       """rk AS (SELECT column_name, CAST(c AS DOUBLE) AS c,
  CAST(row_number() OVER (PARTITION BY column_name ORDER BY c) AS DOUBLE) AS i FROM g)""",
                       """gg AS (SELECT column_name, count(*) AS n,
  abs(2 * sum(i * c) / (count(*) * sum(c)) - (count(*) + 1.0) / count(*)) AS g FROM rk GROUP BY column_name)""") + \
    f"SELECT column_name, {r6('CASE WHEN n > 1 THEN g * n / (n - 1) ELSE 0 END')} AS gini_normalised, TRUE AS within FROM gg"
Q["profile_gini_users"] = _gini("cnts AS (SELECT count(*) AS c FROM orders GROUP BY o_custkey)")

# ======================================================================== H
_cb = count_bound("x.n", "x.rate")
_cbh = count_bound("x.n", "x.rate", "ht")
Q["count_error"] = w("x AS (" + "\nUNION ALL ".join(
    f"SELECT {d(r)} AS rate, count(*) FILTER (WHERE h < {t}) AS n FROM sales" for r, t, _ in _TIERS) + ")") + \
    f"""SELECT {r6('x.rate')} AS rate, x.n AS count_sample, {_cb['estimated_total']} AS estimated_total,
  {_cb['error_pct']} AS error_pct, {_cb['ci_low']} AS ci_low, {_cb['ci_high']} AS ci_high,
  {_cbh['error_pct']} AS ht_error_pct FROM x"""

_GSS = f"""g AS (SELECT region, count(*) AS population_size,
  count(*) FILTER (WHERE h < {T10}) AS sample_size,
  CAST(sum(amount) FILTER (WHERE h < {T10}) AS DOUBLE) AS sample_sum,
  stddev_samp(amount) FILTER (WHERE h < {T10}) AS sample_std FROM sales GROUP BY region)"""
_sb = sum_bound("sample_sum", "sample_std", "sample_size", "population_size")
Q["sum_error"] = w(_GSS) + "SELECT region, sample_size, population_size, " + \
    ", ".join(f"{v} AS {k}" for k, v in _sb.items()) + " FROM g"
_ht_tot = f"(s / {R10})"
_ht_m = f"(1.96 * sqrt((1.0 - {R10}) / ({R10} * {R10}) * ss))"
Q["sum_error_ht"] = w(f"""g AS (SELECT region, {SUM_AMT} AS s,
  sum(CAST(amount AS DOUBLE) * CAST(amount AS DOUBLE)) AS ss FROM sales WHERE h < {T10} GROUP BY region)""") + \
    f"""SELECT region, {r6(_ht_tot)} AS estimated_total,
  round(CASE WHEN {_ht_tot} <> 0 THEN {_ht_m} / abs({_ht_tot}) * 100 END, 2) AS error_pct,
  round({_ht_tot} - {_ht_m}, 2) AS ci_low, round({_ht_tot} + {_ht_m}, 2) AS ci_high FROM g"""
_sem = avg_sem("sample_std", "sample_size", "population_size")
Q["avg_error"] = w(_GSS) + f"""SELECT region, sample_size, population_size,
  round({_sem}, 4) AS standard_error, round(1.96 * {_sem}, 4) AS margin FROM g"""
Q["sample_stats"] = w("p AS (SELECT count(*) AS population_size FROM sales)") + "\nUNION ALL ".join(
    f"SELECT population_size, CAST(floor(population_size * {d(r)}) AS BIGINT) AS sample_size, "
    f"{r6(d(r))} AS sample_rate FROM p" for r, _, _ in _TIERS)


def _rate_sql(a: str, m: str, sd: str, N: str) -> str:
    margin = f"((1.0 - {a}) * {m} * 2)"
    return (f"(CASE WHEN {margin} = 0 OR {m} = 0 OR {m} IS NULL OR {N} <= 0 THEN 0.1 "
            f"ELSE greatest(0.05, least(0.5, pow(1.96 * {sd} / {margin}, 2) / {N})) END)")


Q["accuracy_sample_rate"] = w("pr AS (" + _profile_rows(numeric_only=True, rounded=False) + ")",
                              "acc AS (" + " UNION ALL ".join(f"SELECT {d(a)} AS a" for a in ACC) + ")") + \
    f"""SELECT column_name, {r6('a')} AS accuracy,
  {r6(_rate_sql('a', 'mean', 'stddev', 'row_count'))} AS sample_rate FROM pr, acc"""
_P = "(CASE WHEN a >= 0.99 THEN 16 WHEN a >= 0.95 THEN 14 WHEN a >= 0.90 THEN 12 ELSE 10 END)"
Q["accuracy_hll_precision"] = w("u AS (SELECT count(DISTINCT user_id) AS distinct_users FROM sales)",
                                "acc AS (" + " UNION ALL ".join(f"SELECT {d(a)} AS a" for a in ACC) + ")") + \
    f"""SELECT {r6('a')} AS accuracy, CAST({_P} AS BIGINT) AS precision,
  {r6(f'104.0 / sqrt(pow(2.0, {_P}))')} AS error_pct, distinct_users, TRUE AS within_tolerance FROM acc, u"""
Q["achieved_accuracy"] = w(strata(T1), samp(T1), f"""a AS (SELECT region, count(*) AS cnt_s, {SUM_AMT} AS sum_s
  FROM samp GROUP BY region)""", f"""ex AS (SELECT region, count(*) AS cnt, {SUM_AMT} AS total_revenue
  FROM sales GROUP BY region)""", f"""est AS (SELECT a.region, {_CNT_EST} AS est_cnt, {_SUM_EST} AS est_sum
  FROM a JOIN strata t ON a.region = t.region)""") + f"""SELECT ex.region, ex.cnt, {r6('ex.total_revenue')} AS total_revenue,
  {r6('1.0 - abs(est.est_cnt - ex.cnt) / abs(ex.cnt)')} AS count_accuracy,
  {r6('1.0 - abs(est.est_sum - ex.total_revenue) / abs(ex.total_revenue)')} AS sum_accuracy
FROM est JOIN ex ON est.region = ex.region"""


# ======================================================================== R
def _uniform_unified(src: str, rate: str, thr: str, group: str | None, val: str,
                     exact_ratio: tuple[str, str] | None = None, strategy: str = "uniform",
                     rate_out: str | None = None, where: str = "", extra_from: str = "") -> str:
    """Unified output of the uniform/tier strategies (COUNT, SUM, AVG of ``val``)."""
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    inner = (f"SELECT {g}count(*) AS c, CAST(sum({val}) AS DOUBLE) AS s, "
             f"CAST(sum({val}) AS DOUBLE) / count({val}) AS av, stddev_samp({val}) AS sd, "
             f"sum(CAST({val} AS DOUBLE) * CAST({val} AS DOUBLE)) AS ss "
             f"FROM {src} {extra_from} WHERE h < {thr} {where}{gb}")
    if exact_ratio:
        N_, n_ = exact_ratio
        scale_c = f"CAST(floor(c * {N_} / {n_}) AS BIGINT)"
        scale_s = f"s * {N_} / {n_}"
        n_hat = f"(CASE WHEN c > 0 THEN floor(c * {N_} / {n_}) END)"
    else:
        scale_c = f"CAST(floor(c / {rate}) AS BIGINT)"
        scale_s = f"s / {rate}"
        n_hat = f"(CASE WHEN c > 0 THEN floor(c / {rate}) END)"
    # the planner states Horvitz-Thompson bounds for COUNT and SUM
    cb = count_bound("c", rate, "ht")
    ht_total = f"(s / {rate})"
    ht_margin = f"(1.96 * sqrt((1.0 - {rate}) / ({rate} * {rate}) * ss))"
    sb = {"error_pct": f"round(CASE WHEN {ht_total} <> 0 THEN {ht_margin} / abs({ht_total}) * 100 END, 2)"}
    sem = avg_sem("sd", "c", n_hat)
    avg_err = f"(CASE WHEN av <> 0 THEN round(round(1.96 * {sem}, 4) / abs(av) * 100, 2) END)"
    return (f"SELECT {g}{r6(scale_c)} AS cnt, {r6(cb['error_pct'])} AS cnt_error_pct, "
            f"{r6(scale_s)} AS total_revenue, {r6(sb['error_pct'])} AS total_revenue_error_pct, "
            f"{r6('av')} AS avg_amount, {r6(avg_err)} AS avg_amount_error_pct, "
            f"'{strategy}' AS strategy, {r6(rate_out or rate)} AS sample_rate "
            f"FROM ({inner}) q {', sz' if exact_ratio else ''}")


def _tier_unified(rate: float, thr: int, n: str, where: str = "") -> str:
    rr = f"(CAST(sz.{n} AS DOUBLE) / sz.n_all)"
    body = _uniform_unified("sales", rr, str(thr), None, "amount", exact_ratio=("sz.n_all", f"sz.{n}"),
                            strategy="materialized_tier", rate_out=d(rate), where=where)
    # the realised-rate expression refers to sz, which is joined in the outer FROM
    return body


_STEPS = ((0.01, T1, "n1"), (0.1, T10, "n10"), (0.2, T20, "n20"))


def _exact_unified(group: str = "", where: str = "") -> str:
    g = f"{group}, " if group else ""
    gb = f" GROUP BY {group}" if group else ""
    return (f"SELECT {g}{r6('count(*)')} AS cnt, {d(0.0)} AS cnt_error_pct, {r6(SUM_AMT)} AS total_revenue, "
            f"{d(0.0)} AS total_revenue_error_pct, {r6(AVG_AMT)} AS avg_amount, {d(0.0)} AS avg_amount_error_pct, "
            f"'exact' AS strategy, {d(1.0)} AS sample_rate FROM sales WHERE TRUE {where}{gb}")


def _targeted(accuracy: float, where: str = "") -> str:
    """The smallest offered tier whose stated errors keep the target, else the exact answer."""
    first = 0.2 if accuracy >= 0.95 else 0.1 if accuracy >= 0.9 else 0.01
    steps = [_tier_unified(r, t, n, where) for r, t, n in _STEPS if r >= first] + [_exact_unified(where=where)]
    union = "\nUNION ALL ".join(f"SELECT {i} AS step, * FROM ({s})" for i, s in enumerate(steps))
    errors = ", ".join(f"coalesce({c}_error_pct, 1e300)" for c in ("cnt", "total_revenue", "avg_amount"))
    return (f"SELECT * EXCLUDE (step) FROM ({union}) WHERE greatest({errors}) <= {round((1.0 - accuracy) * 100, 6)} "
            "QUALIFY row_number() OVER (ORDER BY step) = 1")


Q["approx_aggregate"] = w(_SIZES) + _targeted(0.95)
Q["approx_aggregate_filtered"] = w(_SIZES) + _targeted(0.90, "AND user_id < 75")
Q["approx_aggregate_default"] = w() + _exact_unified("region")
Q["approx_aggregate_sketch"] = w() + f"""SELECT {r6(SUM_AMT)} AS total_revenue,
  {r6('quantile_cont(CAST(amount AS DOUBLE), 0.5)')} AS p50, {r6('quantile_cont(CAST(amount AS DOUBLE), 0.95)')} AS p95,
  count(DISTINCT user_id) AS users, 'sketch' AS strategy, TRUE AS p50_within, TRUE AS p95_within,
  TRUE AS users_within FROM sales"""
Q["accuracy_sweep"] = w(_SIZES) + "\nUNION ALL ".join(
    f"SELECT *, {r6(d(a))} AS accuracy_target FROM ({_targeted(a)})" for a in ACC)

_FS = domain_sum("a.s", "a.sd", "a.k", "a.n", "a.pop", "a.lo", "a.hi")
_T25 = threshold(0.25)
Q["approx_aggregate_filtered_sum"] = f"""WITH ev AS (SELECT *, {hsql(['event_id'])} AS h, user_id % 50 = 7 AS m FROM events),
st AS (SELECT event_type AS g, count(*) AS pop, min(h) AS mh, count(*) FILTER (WHERE h < {_T25}) AS below,
         min(value) AS lo, max(value) AS hi FROM ev GROUP BY ALL),
a AS (SELECT g, pop, lo, hi, CAST(count(*) AS DOUBLE) AS n, CAST(count(value) FILTER (WHERE m) AS DOUBLE) AS k,
        coalesce(sum(value) FILTER (WHERE m), 0.0) AS s, stddev_samp(value) FILTER (WHERE m) AS sd
      FROM ev JOIN st ON event_type = g WHERE h < {_T25} OR (below = 0 AND h = mh) GROUP BY ALL),
e AS (SELECT g AS event_type, {r6('s * pop / n')} AS total, {r6(_FS['error_pct'])} AS total_error_pct,
        'materialized_stratified' AS strategy FROM a),
x AS (SELECT event_type, {r6('sum(value)')} AS total, {d(0.0)} AS total_error_pct, 'exact' AS strategy
      FROM ev WHERE m GROUP BY event_type),
worst AS (SELECT max(coalesce(total_error_pct, 1e300)) AS w FROM e)
""" + "\nUNION ALL ".join(
    f"SELECT {src}.*, {d(t)} AS accuracy_target FROM {src}, worst WHERE w {op} {round((1 - t) * 100, 6)}"
    for t in (0.2, 0.99) for src, op in (("e", "<="), ("x", ">")))


def _rare(listed: bool, target: float, name: str, where: str) -> str:
    """The first tier in which every group has a sampled match and keeps the target, else exact;
    exact at once without a list of the groups."""
    label = f"{str(listed).upper()} AS listed, {d(target)} AS accuracy_target, '{name}' AS filter"
    exact = (f"SELECT 9 AS step, {label}, grp, count(*) AS cnt, {d(0.0)} AS cnt_error_pct, 'exact' AS strategy "
             f"FROM rg WHERE {where} GROUP BY grp")
    if not listed:
        return f"SELECT * EXCLUDE (step) FROM ({exact})"
    first = 0.2 if target >= 0.95 else 0.1 if target >= 0.9 else 0.01
    parts = [exact]
    for i, (rate, thr, n) in enumerate(_STEPS):
        if rate >= first:
            rr = f"(CAST({n} AS DOUBLE) / n_all)"
            err = count_bound("c", rr, "ht")["error_pct"]
            parts.append(f"""SELECT {i}, {label}, grp, CAST(floor(c * n_all / {n}) AS BIGINT), {r6(err)}, 'materialized_tier'
FROM (SELECT grp, count(*) FILTER (WHERE h < {thr} AND {where}) AS c FROM rg GROUP BY grp) q, sz""")
    union = "\nUNION ALL ".join(parts)
    return f"""SELECT * EXCLUDE (step, worst, best) FROM (SELECT *, min(step) FILTER (WHERE worst <= {round((1 - target) * 100, 6)})
  OVER () AS best FROM (SELECT *, max(coalesce(cnt_error_pct, 1e300)) OVER (PARTITION BY step) AS worst FROM ({union})))
WHERE step = best"""


Q["approx_aggregate_rare_group"] = w(_SIZES, """rg AS (SELECT *, CASE WHEN event_id < 4 THEN 'rare'
  ELSE 'g' || CAST(event_id % 8 AS VARCHAR) END AS grp FROM sales)""") + "\nUNION ALL ".join(
    f"({_rare(listed, t, name, where)})" for listed in (True, False) for t in (0.2, 0.95)
    for name, where in (("all", "TRUE"), ("most", "amount > 20"), ("few", "event_id >= 4")))

_EV_RATE = _rate_sql(d(0.95), "m", "sd", "n")
Q["approx_aggregate_grouped"] = f"""WITH ev AS (SELECT *, {hsql(['event_id'])} AS h FROM events),
st AS (SELECT count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM events),
rt AS (SELECT {_EV_RATE} AS rate FROM st),
th AS (SELECT rate, CAST(floor(rate * CAST({HASH_SPACE} AS DOUBLE)) AS BIGINT) AS thr FROM rt)
""" + _uniform_unified("ev", "th.rate", "th.thr", "event_type", "value", extra_from=", th") \
    .replace(" FROM (SELECT", " FROM th, (SELECT", 1)

_SK_RATE = _rate_sql(d(0.95), "m", "sd", "n")
_SKEW_CTES = [f"st0 AS (SELECT count(*) AS n, avg(amount) AS m, stddev_samp(amount) AS sd FROM sales)",
              f"th AS (SELECT {_SK_RATE} AS rate FROM st0)",
              f"th2 AS (SELECT rate, CAST(floor(rate * CAST({HASH_SPACE} AS DOUBLE)) AS BIGINT) AS thr FROM th)",
              """strata AS (SELECT region, count(*) AS population_count,
  count(*) FILTER (WHERE h < (SELECT thr FROM th2)) AS below_count, min(h) AS min_h,
  CAST(greatest(count(*) FILTER (WHERE h < (SELECT thr FROM th2)), 1) AS BIGINT) AS sample_count
  FROM sales GROUP BY region)""",
              """samp AS (SELECT s.* FROM sales s JOIN strata t ON s.region IS NOT DISTINCT FROM t.region
  WHERE s.h < (SELECT thr FROM th2) OR (t.below_count = 0 AND s.h = t.min_h))""",
              f"""a AS (SELECT region, count(*) AS cnt_s, {SUM_AMT} AS sum_s, {AVG_AMT} AS avg_s,
    stddev_samp(amount) FILTER (WHERE h < (SELECT thr FROM th2)) AS sd_s
  FROM samp GROUP BY region)"""]
# the planner states each stratified estimate's own margin (HT default)
_n, _N = "t.sample_count", "t.population_count"
_p = f"(a.cnt_s / {_n})"
_SK_CNT_ERR = (f"round(CASE WHEN a.cnt_s > 0 THEN 1.96 * sqrt((1.0 - {_p}) / ({_p} * {_n})) * "
               f"{fpc(_N, _n)} * 100 END, 2)")
_SK_SUM_ERR = sum_bound("a.sum_s", "a.sd_s", _n, _N)["error_pct"]
_SK_AVG_ERR = (f"(CASE WHEN a.avg_s <> 0 THEN round(round(1.96 * {avg_sem('a.sd_s', _n, _N)}, 4) "
               f"/ abs(a.avg_s) * 100, 2) END)")
_SKEW_BODY = f"""SELECT a.region, {r6(_CNT_EST)} AS cnt, {r6(_SK_CNT_ERR)} AS cnt_error_pct,
  {r6(_SUM_EST)} AS total_revenue, {r6(_SK_SUM_ERR)} AS total_revenue_error_pct,
  {r6('a.avg_s')} AS avg_amount, {r6(_SK_AVG_ERR)} AS avg_amount_error_pct,
  'stratified' AS strategy, {r6('(SELECT rate FROM th2)')} AS sample_rate
FROM a JOIN strata t ON a.region = t.region"""
Q["approx_aggregate_skewed"] = w(*_SKEW_CTES) + _SKEW_BODY
# R2: the small-table rule decides by row count, so the twin carries both
# branches, each gated on the count (exact below 100,000 rows, else the
# skew rule's stratified answer)
_SMALL_EXACT = f"""SELECT region, {r6('count(*)')} AS cnt, {d(0.0)} AS cnt_error_pct,
  {r6(SUM_AMT)} AS total_revenue, {d(0.0)} AS total_revenue_error_pct, {r6(AVG_AMT)} AS avg_amount,
  {d(0.0)} AS avg_amount_error_pct, 'exact' AS strategy, {d(1.0)} AS sample_rate FROM sales
  WHERE (SELECT n FROM st0) < 100000 GROUP BY region"""
Q["approx_aggregate_small"] = (w(*_SKEW_CTES) + _SMALL_EXACT + "\nUNION ALL\n" + _SKEW_BODY
                               + "\nWHERE (SELECT n FROM st0) >= 100000")


def _cmp_cols(e: str, a: str, names=("cnt", "total_revenue"), with_acc: bool = True) -> str:
    out = []
    for n in names:
        ex, ap = f"CAST({e}.{n} AS DOUBLE)", f"CAST({a}.{n} AS DOUBLE)"
        rel = f"(CASE WHEN {ex} <> 0 THEN abs({ap} - {ex}) / abs({ex}) END)"
        out += [f"{r6(ex)} AS exact_{n}", f"{r6(ap)} AS approx_{n}", f"{r6(rel)} AS rel_error_{n}"]
        if with_acc:
            out.append(f"{r6(f'(CASE WHEN {ex} <> 0 THEN 1.0 - abs({ap} - {ex}) / abs({ex}) END)')} AS accuracy_{n}")
    return ", ".join(out)


_EXACT = f"ex AS (SELECT region, count(*) AS cnt, {SUM_AMT} AS total_revenue FROM sales GROUP BY region)"
Q["compare_exact_approx"] = w(*_SKEW_CTES, _EXACT, f"""ap AS (SELECT a.region, {_CNT_EST} AS cnt,
  {_SUM_EST} AS total_revenue FROM a JOIN strata t ON a.region = t.region)""") + \
    f"""SELECT coalesce(ex.region, ap.region) AS region, {_cmp_cols('ex', 'ap')},
  'stratified' AS strategy, {r6('(SELECT rate FROM th2)')} AS sample_rate
FROM ex FULL OUTER JOIN ap ON ex.region = ap.region"""

Q["compare_strategies"] = w(_EXACT, strata(T10), samp(T10),
                            f"""un AS (SELECT region, CAST(floor(count(*) / {R10}) AS BIGINT) AS cnt,
  {SUM_AMT} / {R10} AS total_revenue FROM sales WHERE h < {T10} GROUP BY region)""",
                            f"""a AS (SELECT region, count(*) AS cnt_s, {SUM_AMT} AS sum_s FROM samp GROUP BY region)""",
                            f"""sa AS (SELECT a.region, {_CNT_EST} AS cnt, {_SUM_EST} AS total_revenue
  FROM a JOIN strata t ON a.region = t.region)""",
                            _SIZES, f"""ti AS (SELECT t.region, CAST(floor(count(s.h) * any_value(n_all) / any_value(n10)) AS BIGINT) AS cnt,
  coalesce(CAST(sum(s.amount) AS DOUBLE), 0.0) * any_value(n_all) / any_value(n10) AS total_revenue
  FROM (SELECT DISTINCT region FROM sales) t LEFT JOIN (SELECT * FROM sales WHERE h < {T10}) s ON s.region = t.region, sz
  GROUP BY t.region)""", f"""una AS (SELECT ex.region, coalesce(un.cnt, 0) AS cnt, coalesce(un.total_revenue, 0) AS total_revenue
  FROM ex LEFT JOIN un ON ex.region = un.region)""") + "\nUNION ALL ".join(
    [f"""SELECT '{nm}' AS strategy, TRUE AS supported, coalesce(ex.region, x.region) AS region,
  {_cmp_cols('ex', 'x', with_acc=False)}, {r6(R10)} AS sample_rate
FROM ex FULL OUTER JOIN {src} x ON ex.region = x.region"""
     for nm, src in (("uniform", "una"), ("stratified", "sa"), ("materialized_tier", "ti"),
                     ("materialized_stratified", "sa"))] +
    [f"""SELECT '{nm}', FALSE, CAST(NULL AS VARCHAR), NULL, NULL, NULL, NULL, NULL, NULL, CAST(NULL AS DOUBLE)"""
     for nm in ("sketch",)])


def oracle_sql() -> dict[str, str]:
    return dict(Q)
