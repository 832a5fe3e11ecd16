"""Block sampling: whole files of a table, so that the others are never read (C1 at scale).

A row sample drawn at query time reads every row to decide which to keep. Here
the files are drawn: a simple random sample of them, by the hash of their
names, is handed to the Parquet reader. The estimate costs the chosen share of
the bytes; its interval treats each file as one cluster, so a table whose files
differ (sorted or partitioned by the aggregated column) states a wide one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roughcut.functions import bounds
from roughcut.functions.frames import join_on_groups
from roughcut.operators.aggspec import as_aggs
from roughcut.operators.sampling import q

_JOB = re.compile(r"-[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}")  # the writer's job id in a file name


def _draw(path: str, salt: str) -> str:
    """The random number of a file: the hash of its last path parts, without the id of the
    job that wrote it, so the same data written again is drawn alike."""
    name = _JOB.sub("", "/".join(path.split("/")[-3:]))
    return hashlib.md5(f"{salt}:{name}".encode()).hexdigest()


@dataclass
class BlockSample:
    """Rows of the chosen files, the number of files chosen, and of all files."""
    rows: DataFrame
    chosen: int
    files: int


def block_sample(spark: SparkSession, path: str, rate: float, salt: str = "") -> BlockSample:
    """A sample of about ``rate`` of the files below ``path`` (two at least, where there are
    two). Only the file listing is read here."""
    if not 0.0 < rate <= 1.0:
        raise ValueError(f"sample rate must be in (0, 1], got {rate}")
    table = spark.read.parquet(path)
    files = sorted(table.inputFiles(), key=lambda f: (_draw(f, salt), f))
    m = min(len(files), max(2, round(rate * len(files))))
    if m == len(files):
        return BlockSample(table, m, m)
    rows = spark.read.schema(table.schema).option("basePath", path).parquet(*files[:m])
    return BlockSample(rows, m, len(files))


def block_aggregate(sample: BlockSample, aggs, group_by: Sequence[str] = (),
                    where: Column | None = None, confidence: float = 0.95,
                    groups: DataFrame | None = None) -> DataFrame:
    """COUNT, SUM and AVG over a block sample, with cluster-sampling intervals.

    With m of M files and the file totals t: a total is ``M / m * sum(t)`` with
    variance ``M^2 (1 - m/M) s_t^2 / m``; a mean is the ratio of two totals, its
    variance that of the residuals. Files without a matching row count with a
    total of 0. Output per aggregate ``x``: ``x``, ``x_ci_low``, ``x_ci_high``
    and ``x_error_pct``; then ``sample_blocks`` and ``blocks``. With all files
    chosen the answer is exact; with fewer than two files there is no interval.

    A group that lies in no chosen file (or matches there nowhere) is missing, unless
    ``groups`` (the group columns of all groups, see ``SampleStore.known_groups``) names
    it: then its COUNT and SUM are 0, with unknown bounds unless all files were chosen.
    """
    aggs = as_aggs(aggs)
    if any(a.func not in ("count", "sum", "avg") for a in aggs):
        raise ValueError("block samples answer count, sum and avg")
    g = list(group_by)
    rows = sample.rows if where is None else sample.rows.filter(where)
    per_file, sums = [], [F.lit(0)]
    for i, a in enumerate(aggs):
        y = F.lit(1) if a.column == "*" else F.col(a.column)
        n = F.count(y).cast("double")
        per_file += [n.alias(f"__n{i}"),
                     (n if a.func == "count" else F.coalesce(F.sum(y), F.lit(0)).cast("double")).alias(f"__t{i}")]
        t, c = F.col(f"__t{i}"), F.col(f"__n{i}")
        sums += [F.sum(t).alias(f"__st{i}"), F.sum(c).alias(f"__sn{i}"), F.sum(t * t).alias(f"__tt{i}"),
                 F.sum(c * c).alias(f"__nn{i}"), F.sum(t * c).alias(f"__tn{i}")]
    files = rows.groupBy(*g, F.input_file_name().alias("__file")).agg(*per_file)
    total = files.groupBy(*g).agg(*sums[1:]) if g else files.agg(*sums[1:])
    if g and groups is not None:
        total = join_on_groups(total, groups.select(*g), g)
    m, M, z = float(sample.chosen), float(sample.files), bounds.z_value(confidence)
    rest = 1.0 - m / M
    out = [q(c) for c in g]
    for i, a in enumerate(aggs):
        st, sn, tt, nn, tn = (f"__{k}{i}" for k in ("st", "sn", "tt", "nn", "tn"))
        if a.func == "avg":
            est = f"try_divide({st}, {sn})"
            # residuals t - est * n sum to 0 over the files
            ss = f"greatest({tt} - 2 * {est} * {tn} + {est} * {est} * {nn}, 0D)"
            sd = f"try_divide(sqrt({rest}D * {ss} / ({m}D - 1) / {m}D), {sn} / {m}D)"
        else:
            est = f"coalesce({st}, 0D) * {M}D / {m}D"
            ss = f"greatest({tt} - {st} * {st} / {m}D, 0D)"
            sd = f"{M}D * sqrt({rest}D * {ss} / ({m}D - 1) / {m}D)"
        margin = "0D" if m == M else f"{z}D * CASE WHEN {sn} > 0 THEN {sd} END" if m > 1 else "CAST(NULL AS DOUBLE)"
        out += [f"{est} AS {q(a.name)}", f"{est} - {margin} AS {q(a.name + '_ci_low')}",
                f"{est} + {margin} AS {q(a.name + '_ci_high')}",
                f"round(try_divide({margin}, abs({est})) * 100, 2) AS {q(a.name + '_error_pct')}"]
    return total.selectExpr(*out, f"{sample.chosen} AS sample_blocks", f"{sample.files} AS blocks")
