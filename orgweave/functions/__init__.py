"""Column functions: URLs, names, HTML, predicates."""
