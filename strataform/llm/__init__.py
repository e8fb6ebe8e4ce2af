"""Training-data operators: dedup, decontamination, extraction, quality, packing."""
