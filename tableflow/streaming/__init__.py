"""Structured Streaming glue: the same steps, batch by batch."""
