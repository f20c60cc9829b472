"""Scored game positions and the experiments built on them, as Spark DataFrames."""
