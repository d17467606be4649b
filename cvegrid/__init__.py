"""Vulnerability-priority analytics as Spark DataFrames."""
