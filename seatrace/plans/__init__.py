"""Composed plans: the model run, its publication, and the queries over the test tables."""
