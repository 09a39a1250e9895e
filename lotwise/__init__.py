"""Property-table analytics on Spark: clean, derive, encode, compare, score, explain, profile."""

__version__ = "0.1.0"
