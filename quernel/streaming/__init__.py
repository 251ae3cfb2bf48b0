"""Query batches: a stream of text lines in, a stream of result lines out."""
