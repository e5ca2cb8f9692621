"""Training-data operators: counting, deduplication, scoring, encoding, search and mixing."""
