"""Column functions: keys, scores and mutation notation, all native Spark expressions."""
