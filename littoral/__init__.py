"""Coastal-hazard analytics on Spark: DataFrame operators, sources, functions and streams."""
