"""Analysis of a stream of documents. The chain up to stemming is stateless, so it runs on streams as on tables."""
