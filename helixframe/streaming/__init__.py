"""Structured Streaming forms of the ordered operators and of the event logs."""
