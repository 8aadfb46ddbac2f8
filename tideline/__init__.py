"""Spark jobs that prepare, forecast and score many hourly or daily series at once."""
