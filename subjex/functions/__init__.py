"""Column-level helpers (Spark SQL built-ins only)."""
