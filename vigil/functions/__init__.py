"""Column functions: enrichment of raw fields and statistics."""
