"""Operators for training-data pipelines: deduplication, search, scans, mixing, packing.

Nothing outside this folder imports it.  Each module holds one operator with its own
general interface and the thin ``opN_*`` query on top of it; ``registry`` lists the queries.
"""
