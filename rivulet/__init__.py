"""Leakage-aware analytics over wide flow and event tables, on Spark."""
