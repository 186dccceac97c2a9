"""Training-data operators: search, scans, scoring, tokenising, deduplication and decontamination at corpus scale."""
