"""Event-impact and volatility analytics over panel time series, on Spark DataFrames."""
