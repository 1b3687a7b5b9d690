"""Lineage helpers and the queries over the driver's tables."""
