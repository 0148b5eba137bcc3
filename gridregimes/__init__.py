"""gridregimes: Spark batch jobs for gridded and annual time series."""
