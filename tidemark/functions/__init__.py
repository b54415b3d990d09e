"""Functions of the rollup engine."""
