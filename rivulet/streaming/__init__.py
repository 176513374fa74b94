"""Streaming versions of batch checks."""
