"""streetlink: street-address parsing, comparing and linking on Spark DataFrames."""

__version__ = "0.1.0"
