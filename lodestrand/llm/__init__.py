"""Training-data operators: deduplication, filtering, extraction, decontamination and packing."""
