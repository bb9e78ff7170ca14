"""Scalar functions: each takes and returns columns and stays in the JVM."""
