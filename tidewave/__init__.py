"""Tidewave: a Spark-first engine for sampled signals and music analysis."""
