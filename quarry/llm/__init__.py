"""Training-data operators: dedup, quality, privacy, mixing, sharding, token files and packing."""
