"""Training-data operators: ten methods for preparing text corpora at scale."""
