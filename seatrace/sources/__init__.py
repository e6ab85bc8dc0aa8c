"""Readers of raw inputs, each to a DataFrame of the schema in ``seatrace.schemas``."""
