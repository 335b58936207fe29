"""Nearest-neighbour and distance-based data mining on PySpark DataFrames."""
