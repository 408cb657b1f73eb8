"""loomdex: code and document intelligence on Spark DataFrames."""

__version__ = "0.1.0"
