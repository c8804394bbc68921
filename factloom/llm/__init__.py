"""Training-data operators: deduplication, quality, mixing, extraction, packing.

Nothing outside this package imports it.  ``queries.QUERIES`` and
``queries.ORACLES`` hold what ``__spark_entry__`` registers.
"""
