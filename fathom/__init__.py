"""Fathom: generalized linear models and their data preparation on Spark DataFrames."""
