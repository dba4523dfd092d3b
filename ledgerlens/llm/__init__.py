"""Training-data operators: sharding, quality rules, near-duplicate and
substring deduplication, decontamination, language-model scoring, tokenizer
round trips, token counts, HTML extraction and URL filters.

Nothing else in the library imports this package."""
