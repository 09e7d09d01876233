"""Training-data operators: formatting, scoring, tokenising, deduplication, mixing and vector search."""
