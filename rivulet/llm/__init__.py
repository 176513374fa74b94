"""Training-data operators: quality, privacy, dedup, decontamination, mixing, scoring.

Every operator takes plain DataFrames and returns DataFrames.  Nothing outside this
subpackage imports it; ``rivulet.llm.catalog`` holds the registered queries and their SQL.
"""
