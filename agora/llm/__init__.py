"""Training-data operators: sharding, deduplication, scoring, tokenising, mixing."""
