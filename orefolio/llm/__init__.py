"""Training-data operators: PII, mixing, BPE, chat formatting, deduplication, search, token output, classifiers."""
