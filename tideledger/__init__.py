"""Trigger-loss analytics on Spark: DataFrames in, DataFrames out.

Every public function takes DataFrames keyed by one or more columns (run, port,
feature, simulation) and returns a lazy DataFrame for all keys at once.
"""
