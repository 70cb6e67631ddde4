"""Training-data operators: mixing, deduplication, media, language, tokens, privacy, quality."""
