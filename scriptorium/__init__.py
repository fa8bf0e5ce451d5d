"""scriptorium: a Spark-native engine that retrieves and prepares supporting
documents for article summaries (ingest, embed, exact top-k, re-rank, prompts,
keyed answer cache)."""

__version__ = "0.1.0"
