"""Writers of the stored tables.

Events, quarantined rows, findings and scores are tables of a store that changes by commits (`snapshots`): a reader sees
all of a run or nothing of it.  Dumps and manifests are documents; a rerun replaces the partitions it produces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.sources.snapshots import Change, commit

EVENTS, QUARANTINE, SCORES = "events", "quarantine", "risk_scores"


def append_events(events: DataFrame, root: str) -> None:
    commit(root, {EVENTS: Change(events, partition_by=("entity_id", "dataset_type"))})


def append_quarantine(rows: DataFrame, root: str) -> None:
    commit(root, {QUARANTINE: Change(rows)})


def append_scores(scores: DataFrame, root: str) -> None:
    commit(root, {SCORES: Change(scores, partition_by=())})


def replace_by_entity(df: DataFrame, root: str, name: str, entities: DataFrame | None = None) -> None:
    """Replace the stored rows of the entities of the run, and of no others, in one step.

    `entities` (entity_id) are those that the run has looked at: the stored rows of an entity without any row in
    `df` go as well.  Without it, only the entities in `df` are replaced.
    """
    looked_at = df.select("entity_id") if entities is None else entities.select("entity_id").union(df.select("entity_id"))
    commit(root, {name: Change(df, looked_at)})


def dump_quarantine(quarantined: DataFrame, summary: DataFrame, path: str) -> None:
    """JSON dump of quarantined rows per entity and submission, with its summary beside it."""
    # towards the output partitions; adaptive execution splits the large ones
    quarantined.hint("rebalance", "entity_id", "submission_id").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy("entity_id", "submission_id").json(f"{path}/rows")
    summary.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "entity_id", "submission_id"
    ).json(f"{path}/summary")


def write_manifests(manifests: DataFrame, path: str) -> None:
    """Manifest documents by entity, year and month."""
    (
        manifests.withColumn("year", F.date_format("generated_at", "yyyy"))
        .withColumn("month", F.date_format("generated_at", "MM"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("entity_id", "year", "month")
        .json(path)
    )
