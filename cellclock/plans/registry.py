"""Named queries over the driver tables, each with its SQL oracle if one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cellclock.plans.fixtures import with_views
from cellclock.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None, views: str = ""):
    """Register ``fn(spark, sf_dir)``; ``views`` names the fixture CTEs the oracle
    uses."""

    def register(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_views(views, oracle) if views else oracle
        return fn

    return register


def load() -> tuple[dict, dict]:
    """Import every query module and return the registries."""
    from cellclock.plans import load_all

    load_all()
    return QUERIES, ORACLES
