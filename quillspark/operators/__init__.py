"""Vector search, ranking, dedup, chunking and routing as DataFrame operators."""
