"""Column expressions: every function here is a plain Spark expression without UDFs."""
