"""Labelled-text curation and robustness evaluation as Spark jobs."""
