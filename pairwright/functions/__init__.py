"""Column-level building blocks: regexes, number text, expressions, transforms, predicates, comparisons."""
