"""Training-data operators (packing, mixing, dedup, classification, search)."""
