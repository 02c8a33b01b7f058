"""Readers from landed files to the logical tables, and the writers back."""
