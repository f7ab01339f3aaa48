"""Time-series, survey and corpus analytics expressed as Spark DataFrames."""
