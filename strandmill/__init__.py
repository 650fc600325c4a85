"""Analytics over large panels of time series, as Spark DataFrames."""
