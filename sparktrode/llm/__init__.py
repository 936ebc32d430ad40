"""Training-data operators: sharding, tokenising, near-duplicates, filters, archives.

Nothing else in the package imports this subpackage.
"""
