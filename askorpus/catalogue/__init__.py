"""The registered queries and the SQL they are checked against."""

from __future__ import annotations

from askorpus.catalogue import crawling, search, texts, conversations  # noqa: F401
from askorpus.catalogue.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
