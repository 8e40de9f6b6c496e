"""Training-data operators: filters, deduplication, mixing, language-model
scoring and token accounting for large text corpora."""
