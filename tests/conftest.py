from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

from vigil.schema import DATASET_EVENT_TYPE, EVENT_COLUMNS  # noqa: E402
from vigil.session import get_spark  # noqa: E402

KIND = {v: k for k, v in DATASET_EVENT_TYPE.items()}


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_spark("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g",
    })
    session.sparkContext.setLogLevel("ERROR")
    if not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session


@pytest.fixture(scope="session")
def make_events(spark):
    """Canonical events of dicts; `kind` is the event type, other keys are columns."""

    def build(*rows: dict):
        filled = []
        for i, row in enumerate(rows):
            row = dict(row)
            kind = row.pop("kind")
            base = {
                "event_id": f"e{i:03d}", "entity_id": "B", "raw_row_index": i + 1, "standard_event_type": kind,
                "dataset_type": KIND[kind],
            }
            filled.append(tuple({**base, **row}.get(c) for c in EVENT_COLUMNS))
        schema = ", ".join(f"{n} {t}" for n, t in EVENT_COLUMNS.items())
        return spark.createDataFrame(filled, schema)

    return build
