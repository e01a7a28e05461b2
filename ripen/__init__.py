"""Conversion analytics under delayed feedback, built on Spark DataFrames."""

__version__ = "0.1.0"
