"""Training-data operators: archives, classifiers, tokenization, search, deduplication, packing."""
