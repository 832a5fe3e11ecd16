"""Column expressions: row hashes, error bounds and accuracy maps."""
from roughcut.functions.hashing import hash60, in_sample, threshold, with_row_hash  # noqa: F401
