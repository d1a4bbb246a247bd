"""Where the catalog modules register their queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from sentiloom.sources.fixtures import Views, with_views


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Views], DataFrame]
    oracle: str | None

    def __call__(self, spark, folder: str) -> DataFrame:
        return self.run(Views(spark, folder))


CATALOG: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, views: str = ""):
    """Register a query; ``oracle`` is DuckDB SQL over the named views."""

    def register(run):
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        sql = None
        if oracle is not None:
            sql = with_views(oracle, *views.split()) if views else oracle.strip()
        CATALOG[name] = Query(name, run, sql)
        return run

    return register
