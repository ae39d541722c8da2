"""Training-data operators: deduplication, joins, quality, privacy, tokenisation, packing."""
