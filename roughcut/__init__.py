"""roughcut: approximate aggregation with stated error, on Spark DataFrames.

Profiles a table, draws uniform and stratified samples (at query time or
stored in accuracy tiers), estimates counts, sums and averages per group
with confidence bounds, counts distinct values and computes quantiles with
mergeable sketches, chooses among these from an accuracy target, and
compares every approximate answer with the exact one. Everything is a lazy
DataFrame plan that runs on the executors.
"""

from roughcut.functions.hashing import hash60, threshold, with_row_hash  # noqa: F401
from roughcut.operators.aggspec import Agg  # noqa: F401
from roughcut.operators.blocks import BlockSample, block_aggregate, block_sample  # noqa: F401
from roughcut.operators.profile import (  # noqa: F401
    cached_profile, frequency_gini, group_distribution, histogram, histogram_gini,
    profile_skew, profile_table,
)
from roughcut.operators.quantile import (  # noqa: F401
    exact_quantile, exact_quantile_grouped, exact_quantiles, exact_quantiles_grouped,
)
from roughcut.operators.samples import SampleStore  # noqa: F401
from roughcut.operators.sampling import sample_aggregate, uniform_sample  # noqa: F401
from roughcut.operators.sketches import (  # noqa: F401
    approx_distinct, approx_quantiles, hll_distinct, kll_quantiles,
)
from roughcut.operators.stratified import (  # noqa: F401
    strata_table, stratified_aggregate, stratified_sample,
)
from roughcut.plans.aggregate import approx_aggregate, exact_aggregate  # noqa: F401
from roughcut.plans.compare import (  # noqa: F401
    accuracy_sweep, compare_exact_approx, compare_strategies,
)
from roughcut.session import ensure_checkpoint_dir, local_session, shared_dir  # noqa: F401
