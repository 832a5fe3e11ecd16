"""Composite plans: accuracy-targeted aggregation and exact/approximate comparison."""
