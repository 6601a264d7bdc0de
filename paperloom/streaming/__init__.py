"""Job state as Structured Streaming queries."""
