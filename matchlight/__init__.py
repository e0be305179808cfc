"""Match analytics on Spark: catalog, vectors, pixels, statistics, telemetry and streams as DataFrame jobs."""
