"""Column builders: hashing, rules, request features."""
