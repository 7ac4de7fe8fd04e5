"""Workforce analytics on Spark: attendance grids and exit-survey answers."""
