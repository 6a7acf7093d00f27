"""Governed analytics on Spark: declared clearances, masks, row policies, history, erasure and retention over DataFrames."""
