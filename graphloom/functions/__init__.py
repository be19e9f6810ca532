"""Column functions: text, predicates, arrays and maps, numbers."""
