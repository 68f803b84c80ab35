"""Cohort analytics and treatment-response modelling on Spark DataFrames."""

__version__ = "0.1.0"
