"""chronoloom: lossless time-series blocks on Spark DataFrames.

Points are ordinary DataFrame rows; block assignment, deltas, XORs, exact bit
costs and statistics are Catalyst expressions; only the emission and reading of
packed bits run as Arrow kernels, one block at a time.
"""

from chronoloom.schema import BLOCK_COLUMNS, DEFAULT_DURATION_MS  # noqa: F401

__all__ = ["BLOCK_COLUMNS", "DEFAULT_DURATION_MS"]
