"""Training-data operators: quality, near duplicates, substring dedup, decontamination, tokenisation and classifiers."""
