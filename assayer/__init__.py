"""Data-quality profiling, cleaning and order analytics as PySpark DataFrame operators."""
