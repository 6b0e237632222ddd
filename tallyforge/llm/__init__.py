"""Training-data operators: sharding, mixing, filtering, tokenising and deduplicating documents.

Nothing else in the library imports this subpackage.
"""
