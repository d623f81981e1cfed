"""Training-data pipeline operators (HTML extraction, deduplication, packing, ...)."""
