"""User-level verbs composed from the operators."""
