"""Named queries over the driver's tables, each beside the SQL that states its result independently."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with its oracle where SQL can state it."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["k9_by_factor"](spark, sf_dir)


def load() -> None:
    """Registers the queries of all plan modules."""
    from freshet.plans import columns, datasets, evidence, files, joins, learning, networks, scores, summaries, trials  # noqa: F401
