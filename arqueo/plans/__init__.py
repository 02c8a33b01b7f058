"""The jobs a user calls: one function per report."""
