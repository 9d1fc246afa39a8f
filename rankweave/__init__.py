"""Ranking analytics on impression logs, written as Spark DataFrame functions.

Every operator takes and returns DataFrames keyed by ``(split, row_id)`` and leaves
the physical plan to Catalyst and adaptive execution.
"""

__version__ = "0.1.0"
