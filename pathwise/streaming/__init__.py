"""Event-time and stateful streaming."""
