"""Training-data operators: quality, language, duplicates, leakage, mixing, tokens, search and pages."""
