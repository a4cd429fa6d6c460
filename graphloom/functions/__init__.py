"""Column expressions: order hashes, predicates, text and vector functions."""
