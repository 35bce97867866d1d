"""Time-ordered citation examples and forecasts as Spark DataFrame operators."""
