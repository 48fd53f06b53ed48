"""Training-data operators: deduplication, extraction, filtering, mixing and output."""
