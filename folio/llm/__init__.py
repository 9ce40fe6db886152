"""Training-data pipeline operators: deduplication, filtering, scoring, packing."""
