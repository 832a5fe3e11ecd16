"""Parquet sources and sinks."""
from roughcut.sources.tables import (  # noqa: F401
    ROW_KEYS, TABLES, derive_sales, generate_sales, load_sales, read_table,
    register_tables, sales_with_hash, table_path, write_parquet,
)
