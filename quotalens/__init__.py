"""Quota telemetry and token-usage analytics on Spark DataFrames."""
