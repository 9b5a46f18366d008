"""Spark jobs for scoring very large prompt batches and reporting on the results."""
