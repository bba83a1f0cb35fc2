"""Driver-based revenue forecasting as Spark jobs."""
