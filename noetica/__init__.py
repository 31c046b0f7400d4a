"""Spark-first engine for personal-knowledge quads, enrichment and entity resolution."""
