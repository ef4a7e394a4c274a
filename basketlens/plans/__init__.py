"""End-to-end plans: the pipeline and the registered (checked) queries."""
