"""Structured Streaming façade."""
