"""Web-audit analytics on Spark: crawls, crawl histories and access logs as DataFrames."""

__version__ = "0.1.0"
