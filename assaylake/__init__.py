"""Cohort-scale association analytics on Spark: small functions over DataFrames."""
