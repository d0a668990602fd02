"""Training-data operators: token counts, language, duplicates, personal data, packing, pages."""
