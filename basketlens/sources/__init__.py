"""Sources (CSV, catalog, parquet, TPC-H-style fixture) and sinks (tables, CSV)."""
