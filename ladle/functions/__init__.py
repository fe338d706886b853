"""Column expressions: scalars, ranks and tiers, statistics."""
