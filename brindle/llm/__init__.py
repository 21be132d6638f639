"""Training-data operators: quality, safety, deduplication, decontamination, mixing and formatting."""
