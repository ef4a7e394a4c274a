"""Operators for preparing training text at scale (optional part of the package)."""
