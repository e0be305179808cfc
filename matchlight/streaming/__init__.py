"""Structured Streaming twins of the batch telemetry."""
