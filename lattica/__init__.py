"""lattica: sparse-volume, point and mesh analytics as lazy Spark DataFrames."""
