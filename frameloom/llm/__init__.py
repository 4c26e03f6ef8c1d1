"""Training-data pipeline operators: tokenising, filtering, deduplicating,
packing, searching and scoring text at corpus scale."""
