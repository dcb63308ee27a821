"""Training-data operators: dedup, packing, tokenizing, archives, search, sharding, quality.

Nothing else in the library imports this subpackage; it can be deleted on its own.
"""
