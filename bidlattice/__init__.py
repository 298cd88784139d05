"""Procurement-graph analytics and large-corpus text operators on Spark DataFrames."""

__version__ = "0.1.0"
