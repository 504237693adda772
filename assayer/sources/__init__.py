"""CSV folders in, tables and reports out."""
