"""Training-data operators: deduplication, decontamination, mixing, token output and their companions."""
