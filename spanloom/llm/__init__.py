"""Training-data operators: dedup, packing, scoring, search, filtering, formatting."""
