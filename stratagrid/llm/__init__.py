"""Training-data operators: deduplication, filtering, scanning, encoding and packing of text corpora.

Nothing else in the library imports this subpackage.
"""
