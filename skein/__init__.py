"""skein: ordered-text reduction and savings analytics on Spark DataFrames."""

__version__ = "0.1.0"
