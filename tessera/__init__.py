"""Spark-native subclonal analytics: cohorts of tumors as DataFrames keyed by tumor, mutation and region."""

__version__ = "0.1.0"
