"""sedimenta: an embedded-store query engine re-expressed on Spark DataFrames."""

__version__ = "0.1.0"
