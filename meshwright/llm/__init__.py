"""Training-data operators: quality, deduplication, tokenization, search, language, toxicity, mixing, chat."""
