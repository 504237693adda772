"""Column -> Column expressions. Native Spark functions only, no Python UDFs."""
