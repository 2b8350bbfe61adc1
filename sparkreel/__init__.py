"""sparkreel: frame-stream analytics as Spark DataFrames."""
