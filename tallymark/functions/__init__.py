"""Column-level building blocks: value rendering, predicates, comparison."""
