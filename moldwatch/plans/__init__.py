"""Compositions of operators that answer one user question each."""
