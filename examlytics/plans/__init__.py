"""Query registry (catalog), fixture views and the DuckDB oracle."""
