"""flightlake: sessionised sensor telemetry as Spark jobs."""
