"""DataFrame operators: citations, sequences, slices, folds, batches, metrics and run history."""
