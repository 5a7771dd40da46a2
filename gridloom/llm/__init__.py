"""Training-data operators: deduplication, extraction, scoring, privacy and packing."""
