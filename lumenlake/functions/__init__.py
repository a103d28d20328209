"""Column builders: predicates, templates, time steps."""
