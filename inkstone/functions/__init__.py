"""Column functions: text rules, quality measures, layout predicates."""
