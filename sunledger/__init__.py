"""Telemetry jobs on Spark: DataFrame in, DataFrame out."""
