"""Sources of the rollup engine."""
