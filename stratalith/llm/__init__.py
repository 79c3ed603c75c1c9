"""Training-data operators: packing, quality, dedup, search, token counts, language, mixing."""
