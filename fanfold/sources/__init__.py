"""Readers and writers built on Spark's own file formats."""
