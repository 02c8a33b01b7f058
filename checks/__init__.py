"""The jobs bound to the given tables, with the same questions in SQL."""
