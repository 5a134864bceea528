"""Supervisory security analytics on Spark: ingestion, process-gap rules, absence checks,
correlation, peer benchmarking, risk scores and Merkle manifests, for all organisations at once."""

from vigil.session import configure, get_spark

__all__ = ["configure", "get_spark"]
