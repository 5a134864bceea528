"""Importing this module registers all queries."""

from vigil.catalog import absence_queries, audit_queries, ingest_queries, peer_queries, rule_queries, view_queries  # noqa: F401
