"""Training-data operators: mixing, packing, extraction, scans, scoring, near-duplicates, search, token files."""
