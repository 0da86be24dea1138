"""Training-data operators: scoring, deduplication, packing, indexing, extraction.

Nothing outside this subpackage imports it.  ``registry.py`` holds the queries
and their SQL; ``__spark_entry__.py`` adds them when the subpackage is there.
"""
