"""Listing enrichment on Spark: lists of names plus crawled pages in, one enriched row per listing out."""
