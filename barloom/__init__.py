"""Market-data analytics on Spark: one lazy plan over all tickers."""
