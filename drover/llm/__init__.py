"""Training-data pipeline operators (mixing, language, near-duplicates, vectors,
tokens, toxicity, personal data, secrets).  Nothing else in the library imports
this subpackage."""
