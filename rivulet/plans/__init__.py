"""Whole experiments, their command line, and the query catalogue."""
