"""Plate-recognition analytics on Spark: sources, operators, functions, plans and streaming."""
