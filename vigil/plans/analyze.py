"""A full supervisory run: all engines over all entities, as named lazy DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.operators.absence import evaluate_checks
from vigil.operators.cards import rationale_cards
from vigil.operators.correlation import correlate
from vigil.operators.execution_gaps import Period, evaluate_rules
from vigil.operators.peers import benchmark_entities, cohort_benchmarks, entity_metrics, peer_evaluations
from vigil.operators.risk import risk_scores
from vigil.operators.rules import Registry
from vigil.schema import of_type
from vigil.session import cut_lineage
from vigil.sources.sinks import SCORES
from vigil.sources.snapshots import Change, commit


@dataclass(frozen=True)
class Run:
    gaps: DataFrame
    absences: DataFrame
    edges: DataFrame
    clusters: DataFrame
    members: DataFrame
    metrics: DataFrame
    benchmarks: DataFrame
    peers: DataFrame
    scores: DataFrame
    cards: DataFrame
    entities: DataFrame


def analyze(
    events: DataFrame,
    entities: DataFrame,
    period: Period,
    as_of: datetime | None = None,
    rules: Registry | None = None,
    checks: Registry | None = None,
    previous: DataFrame | None = None,
    period_only: bool = False,
    parity: bool = False,
    burst: dict | None = None,
) -> Run:
    """Findings, metric snapshots and burst candidates are stored on the way, because several outputs
    read them; everything else stays lazy and runs when its table is written.

    `period_only` restricts the events to the period; `parity` counts every open case as stale.
    """
    as_of = as_of or period.end
    if period_only:
        start, end = period.columns()
        events = events.where(F.col("event_timestamp").between(start, end))
    gaps = cut_lineage(evaluate_rules(events, period, rules))
    absences = cut_lineage(evaluate_checks(events, period, checks))
    edges, clusters, members = correlate(events, **(burst or {}))
    metrics = entity_metrics(entities, events, gaps, as_of, parity)
    benchmarks = benchmark_entities(metrics)
    peers = peer_evaluations(benchmarks)
    alert_counts = of_type(events, "alert_metadata").groupBy("entity_id").agg(F.count("*").alias("alerts"))
    scores = risk_scores(entities, alert_counts, gaps, absences, peers, period, as_of, previous)
    return Run(
        gaps, absences, edges, clusters, members, metrics,
        cohort_benchmarks(benchmarks, *period.columns()), peers, scores, rationale_cards(gaps, absences),
        entities.select("entity_id"),
    )


def run_counts(run: Run) -> DataFrame:
    """Rows of every output per entity."""
    named = {
        "execution_gaps": run.gaps, "absences": run.absences, "correlations": run.edges,
        "burst_clusters": run.clusters, "cards": run.cards,
    }
    parts = [df.select("entity_id", F.lit(n).alias("output")) for n, df in named.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("entity_id", "output").agg(F.count("*").alias("rows"))


FINDINGS = ("execution_gaps", "absences", "correlations", "cards")


def persist_run(run: Run, path: str) -> None:
    """Replace findings, correlations and cards of all entities of the run, also of those without any, and add its scores:
    all in one commit.  Benchmarks of cohorts are overwritten by cohort."""
    run.benchmarks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "sector", "size_tier"
    ).parquet(f"{path}/benchmarks")
    found = dict(zip(FINDINGS, (run.gaps, run.absences, run.edges, run.cards)))
    commit(path, {
        **{name: Change(rows, run.entities) for name, rows in found.items()}, SCORES: Change(run.scores, partition_by=()),
    })
