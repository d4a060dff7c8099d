"""Composed jobs: views over the driver tables, end-to-end plans and the query catalogue."""
