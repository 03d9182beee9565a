"""Streaming token-selection analytics on Spark DataFrames.

Every operator is a function ``DataFrame -> DataFrame`` that only declares a
plan; Catalyst picks the physical strategy.
"""

__version__ = "0.1.0"
