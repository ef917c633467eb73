"""Training-data operators: dedup, filters, sharding, scoring and tokens."""
