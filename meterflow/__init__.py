"""Meter-reading reconciliation and quality analytics as Spark DataFrames."""
