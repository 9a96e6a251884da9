"""Trace analytics and metric first-order temporal logic on Spark DataFrames."""
