"""Column builders: every rule here is a native Spark expression."""
