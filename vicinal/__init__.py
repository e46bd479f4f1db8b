"""Neighbour-graph analytics and layouts of vector data on PySpark."""
