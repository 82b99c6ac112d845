"""Typed property graphs, span and text operators, and timing statistics on Spark."""
