"""Streaming of the rollup engine."""
