"""Sampling, stored-sample, sketch and profiling operators (DataFrame in, DataFrame out)."""
