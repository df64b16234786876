"""Trace analytics on Spark: DataFrame operators over logs of multi-step runs."""
