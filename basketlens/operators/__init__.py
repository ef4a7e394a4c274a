"""The analyses, each a function of a ``Dataset`` returning a lazy DataFrame."""
