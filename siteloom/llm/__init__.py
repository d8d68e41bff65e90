"""Training-data operators: classification, search, deduplication, tokenisation, mixing."""
