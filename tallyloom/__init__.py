"""Spark-first operators for messy business tables, the facts drawn from them and their history."""
