"""Training-data operators: tokenising, packing, sharding, deduplication, filtering and search.

Nothing else in the library imports this subpackage.
"""
