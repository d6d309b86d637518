"""Structured Streaming: record changes merged in micro-batches."""
