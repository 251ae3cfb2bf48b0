"""Query representation, rewrites, SQL text and DataFrame planning."""
