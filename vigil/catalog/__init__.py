"""Registered queries: each runs an operator over the given star-schema tables."""
