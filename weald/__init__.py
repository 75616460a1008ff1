"""Weald: minimum spanning forests and the graph operators they are made of, on Spark DataFrames."""
