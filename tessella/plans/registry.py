"""name -> query, name -> SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans.casts import CASTS
from tessella.sources.tables import VIEWS, view_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Registers a query; views: names of proxy views that the SQL starts with."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            with_ = ", ".join(view_sql(v) for v in views.split() if v in VIEWS)
            text = sql.strip()
            if with_:
                text = f"WITH {with_}, {text[5:]}" if text.upper().startswith("WITH ") else f"WITH {with_} {text}"
            if name in CASTS:
                text = f"SELECT * REPLACE ({', '.join(f'CAST({chr(34)}{c}{chr(34)} AS {t}) AS {chr(34)}{c}{chr(34)}' for c, t in CASTS[name].items())}) FROM ({text})"
            ORACLES[name] = text
        return f

    return put


def js(x: str, digits: int = 0) -> str:
    """half_up() in SQL."""
    return f"(floor(({x}) * {10**digits}.0 + 0.5) / {10**digits}.0)"
