"""Event-time and stateful operators for Structured Streaming."""
