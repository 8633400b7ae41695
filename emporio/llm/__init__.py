"""Training-data pipeline operators: sharding, packing, deduplication, filtering, scanning."""
