"""tidemark: change analytics and record shaping on Spark DataFrames."""

__version__ = "0.1.0"
