"""Smart-meter telemetry analytics as Spark DataFrame and Structured Streaming jobs."""
