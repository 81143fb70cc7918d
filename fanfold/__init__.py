"""Spark-first analytics over large ensembles of independent model runs."""

__version__ = "0.1.0"
