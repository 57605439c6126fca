"""Test-table harness: domain extracts derived from the driver's TPC-H-style tables,
the registered queries and their independent DuckDB oracle SQL."""
