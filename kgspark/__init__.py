"""Spark-native knowledge-graph analytics: every operator takes and returns DataFrames."""
