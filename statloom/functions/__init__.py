"""Column expressions: scores, densities, entropies, quality measures."""
