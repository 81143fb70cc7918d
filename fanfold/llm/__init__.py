"""Operators for preparing training text, each in a module of its own; nothing outside imports them."""
