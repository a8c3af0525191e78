"""Spark ML training, scoring and explanation (ML1-ML7)."""
