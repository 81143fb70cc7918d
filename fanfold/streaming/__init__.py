"""Structured Streaming counterparts of the log, job and metric operators."""
