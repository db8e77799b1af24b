"""Quarry: evidence analytics over documents and tables, as plain Spark plans."""
