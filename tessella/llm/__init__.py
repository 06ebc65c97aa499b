"""Training-data operators: tokenising, quality, sharding, deduplication, personal data, packing."""
