"""Training-data operators: dedup, scoring, sharding, mixing, packing, vector search."""
