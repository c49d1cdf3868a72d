"""Relation-graph, scoring and streaming operators on Spark DataFrames."""
