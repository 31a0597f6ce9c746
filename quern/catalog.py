"""The registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quern.queries import answers, candidates, etl, evaluation, legal, search, sources, text  # noqa: F401  they register themselves
from quern.queries.base import ORACLES, QUERIES

FLAGSHIP = "hybrid_retrieve"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
