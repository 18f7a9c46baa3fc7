"""Training-data operators: filtering, deduplication, decontamination, mixing, formatting and counting."""
