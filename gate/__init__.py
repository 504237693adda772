"""Queries over the driver's tables, with the SQL that must agree with them."""
