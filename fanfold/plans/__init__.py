"""Registered queries, their derived inputs and the SQL they are checked against."""

from importlib import import_module

for _module in ("catalog", "tasks", "results", "jobs", "logs", "metrics", "cost", "configs", "scalars", "stored"):
    import_module(f"fanfold.plans.{_module}")
