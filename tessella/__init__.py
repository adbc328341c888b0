"""Tessella: corpus curation and evaluation as Spark DataFrame operators."""
