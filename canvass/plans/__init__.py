"""Target planning: validation, support, candidate requests, pool, selection, replacement."""
