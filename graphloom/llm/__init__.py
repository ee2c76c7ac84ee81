"""Training-data operators: sharding, toxicity, mixing, deduplication, search and tokenisation."""
