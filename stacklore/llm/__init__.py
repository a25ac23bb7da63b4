"""Training-data operators: quality, near duplicates, sharding, secrets, tokens, personal data, packing."""
