"""Column expressions and the ordered-aggregation primitives operators share."""
