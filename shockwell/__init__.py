"""Volatility and event-study analytics over panels of OHLC bars, as Spark jobs."""
