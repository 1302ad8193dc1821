"""Training-data operators (URL reputation, mixing, deduplication, decontamination, scoring, extraction, search)."""
