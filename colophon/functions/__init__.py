"""Column functions: text normalisation, identifiers, names, pages and tokens."""
