"""Training-data operators: near-dedup, scans, packing, scoring, archives."""
