"""Whole jobs, and the catalogue of queries on the test tables."""
