"""Column expressions: parsing, slot predicates, labels, rounding."""
