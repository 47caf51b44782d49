"""Bayesian linear regression on Spark: data reduced in Catalyst, chains run as tasks, draws as DataFrames."""

__version__ = "0.1.0"
