"""Ingestion over a stream of JSON lines.

Row checks and normalisation are stateless, so the batch expressions apply unchanged.  Keys have state: the first sound row
of a primary key to arrive (within a micro-batch, the one of the smallest row index) is valid and claims it, later
ones are rejected, also after a restart.  A key is forgotten some time after its last row came (twice `delay_ms`, by the
watermark of arrival times), which bounds the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vigil.operators.mapping import normalize
from vigil.operators.validation import primary_key, repeated_key, with_row_error
from vigil.sources.readers import object_map

ROW_SCHEMA = "submission_id string, entity_id string, dataset_type string, row_index bigint, line string"
KEYED = f"{ROW_SCHEMA}, pk string, repeated boolean"
HOUR = 3_600_000


def read_row_stream(spark: SparkSession, path: str) -> DataFrame:
    """Stream of submitted lines with their submission, entity, dataset type and row index."""
    return spark.readStream.schema(ROW_SCHEMA).json(path)


def checked_stream(rows: DataFrame) -> DataFrame:
    data = object_map(F.col("line"))
    parsed = (
        rows.withColumn("data", data)
        .withColumn("is_corrupted", F.col("data").isNull())
        .withColumn("corruption_reason", F.when(F.col("data").isNull(), "Invalid JSON line syntax"))
        .withColumn("raw_text", F.col("line"))
    )
    return with_row_error(parsed)


def _claims(delay_ms: int):
    """Marks all rows of a key but the one that claims it; at most one row is held back."""

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first, last = None, pd.Timestamp.min
        for frame in frames:
            if not state.exists:
                if first is not None:
                    frame = pd.concat([first, frame], ignore_index=True)
                at = frame["row_index"].fillna(float("inf")).argmin()
                first, frame = frame.iloc[[at]], frame.drop(frame.index[at])
            if len(frame):
                last = max(last, frame["arrived"].max())
                yield frame.drop(columns="arrived").assign(repeated=True)
        if first is not None:
            state.update((True,))
            last = max(last, first["arrived"].max())
            yield first.drop(columns="arrived").assign(repeated=False)
        state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + delay_ms)

    return judge


def keyed_stream(rows: DataFrame, delay_ms: int = HOUR) -> DataFrame:
    """The sound rows with a key, and whether another row has claimed it."""
    sound = checked_stream(rows).where(F.col("error").isNull())
    keyed = sound.select(
        "submission_id", "entity_id", "dataset_type", "row_index", "line", primary_key(F.col("data"), F.col("dataset_type")).alias("pk"),
        F.current_timestamp().alias("arrived")).withWatermark("arrived", f"{delay_ms} milliseconds")
    return keyed.where("pk is not null").groupBy("submission_id", "pk").applyInPandasWithState(
        _claims(delay_ms), KEYED, "seen boolean", "append", GroupStateTimeout.EventTimeTimeout)


def stream_events(rows: DataFrame, ingested_at: datetime, delay_ms: int = HOUR) -> DataFrame:
    """Canonical events of the valid rows: sound ones without a key, and those that claim theirs."""
    sound = checked_stream(rows).where(F.col("error").isNull())
    plain = sound.where(primary_key(F.col("data"), F.col("dataset_type")).isNull()).drop("error")
    claimed = checked_stream(keyed_stream(rows, delay_ms).where("not repeated").drop("pk", "repeated")).drop("error")
    return normalize(plain.unionByName(claimed), ingested_at)


def stream_rejects(rows: DataFrame, delay_ms: int = HOUR) -> DataFrame:
    """Rows failing a row check, and rows whose key was claimed before, with their error."""
    columns = ("submission_id", "entity_id", "dataset_type", "row_index", "error", "line")
    failed = checked_stream(rows).where(F.col("error").isNotNull()).select(*columns)
    repeated = keyed_stream(rows, delay_ms).where("repeated").withColumn("error", repeated_key(F.col("pk"))).select(*columns)
    return failed.unionByName(repeated)
