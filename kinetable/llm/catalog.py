"""All queries of the subpackage."""

from __future__ import annotations

from . import collocations, contexttree, decontaminate, embeddings, licenses, maintext, neardup, quality, secrets, substrings, subword, variants, warc  # noqa: F401
from .common import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
