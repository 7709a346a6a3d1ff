"""Fraud forensics on Spark: every detector takes DataFrames and returns DataFrames."""
