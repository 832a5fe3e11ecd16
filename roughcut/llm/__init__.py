"""Operators of a training-data pipeline: deduplication, language, secrets,
mixing, sharding, decontamination and page text.

Each operator is a function from DataFrames to a DataFrame with its own
general interface; :mod:`roughcut.llm.queries` registers one thin query per
operator over the given tables. Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# Tasks carry these functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
