"""From query text to plans."""
