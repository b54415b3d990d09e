"""Plans of the rollup engine."""
