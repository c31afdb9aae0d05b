"""Training-data operators: language ID, tokenisation, scans, deduplication, scoring, sharding, chat formatting."""
