"""All registered queries."""

from __future__ import annotations

from . import candidates, datasets, documents, io, paced, people, pose, sequences, stream, tracking, views  # noqa: F401
from . import registry


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return registry.oracle_sql()
