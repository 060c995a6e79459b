"""Scans and sinks: articles, lexicons, queries, judgements, results, index dumps."""
