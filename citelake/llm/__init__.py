"""Training-data operators: token counts, scans, filters, dedup, packing, search."""
