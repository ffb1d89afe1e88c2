"""Queries over the test tables, each with the SQL that a second engine answers alike."""
