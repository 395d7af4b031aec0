"""Training-data operators: dedup, quality, licences, mixing, language, token files, search, packing."""
