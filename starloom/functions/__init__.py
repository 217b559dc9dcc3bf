"""Column-expression helpers shared by the operators (no Python UDFs)."""
