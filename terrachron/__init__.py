"""terrachron: a spatial-temporal observation memory as PySpark DataFrame operations."""
