"""Text enrichment and precise search on Spark."""
