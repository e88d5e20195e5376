"""Analyses: DataFrame (or dict of DataFrames) in, findings DataFrame out, lazy."""
