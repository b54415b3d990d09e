"""Tenant time-series rollups and corpus operators on PySpark."""
