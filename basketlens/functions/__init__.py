"""Reusable Column expressions: association metrics and fixed label values."""
