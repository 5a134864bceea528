"""Times shared by the tests; a module of its own, because several folders have a `conftest`."""

from __future__ import annotations

from datetime import datetime, timedelta

from vigil.operators.execution_gaps import Period

NOW = datetime(2026, 8, 25, 12, 0)
PERIOD = Period(datetime(2026, 8, 1), NOW)


def at(hours: float) -> datetime:
    """A time `hours` before the end of the test period."""
    return NOW - timedelta(hours=hours)
