"""Term-structure forecasting and evaluation as Spark jobs."""
