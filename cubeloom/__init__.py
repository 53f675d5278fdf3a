"""Climate-cube analytics on Spark: labelled cubes as long DataFrames."""

__version__ = "0.1.0"
