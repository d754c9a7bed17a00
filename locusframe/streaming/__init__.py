"""Windows over unbounded input with Structured Streaming."""
