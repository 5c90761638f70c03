"""Training-data operators: deduplication, mixing, classifiers, language-model scores, fingerprints, BPE."""
