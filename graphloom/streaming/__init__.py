"""Structured Streaming forms of the append, upsert and log sinks."""
