"""Compositions: the plate pipeline, reports, and the queries of the driver contract."""
