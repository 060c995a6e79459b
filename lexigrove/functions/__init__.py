"""Text analysis as column functions, and the stemmer."""
