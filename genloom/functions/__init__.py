"""Column functions: predicates, sequences, peptides, scores."""
