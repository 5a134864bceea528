"""Both kinds of correlation edges in one relation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vigil.operators.bursts import burst_edges, find_bursts
from vigil.operators.notes import note_edges


def correlate(
    events: DataFrame,
    window_seconds: int = 86400,
    min_alerts: int = 5,
    min_high: int = 3,
    cosine: float = 0.85,
    jaccard: float = 0.80,
    min_tokens: int = 10,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, burst clusters, burst members)."""
    clusters, members = find_bursts(events, window_seconds, min_alerts, min_high)
    edges = burst_edges(clusters, members, window_seconds).unionByName(
        note_edges(events, cosine, jaccard, min_tokens)
    )
    return edges, clusters, members
