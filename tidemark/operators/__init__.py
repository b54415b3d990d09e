"""Operators of the rollup engine."""
