"""Registry of runnable queries and the plain SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.sources.driver_tables import POSITIONS_SQL, STREAM_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

VIEWS = {"positions": POSITIONS_SQL, "stream": STREAM_SQL}


def query(name: str, sql: str | None = None, views: str = "") -> Callable[[Query], Query]:
    """Register a query; ``views`` names the adapter views its SQL starts from."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ctes = ",\n".join(VIEWS[v] for v in views.split())
            body = sql.strip()
            head = "WITH"
            if body.startswith("RECURSIVE_"):
                head, body = "WITH RECURSIVE", body[len("RECURSIVE_"):]
            if not ctes:
                plain = body.upper().startswith(("SELECT", "WITH"))
                ORACLES[name] = body if plain else f"{head} {body}"
            elif body.upper().startswith("SELECT"):
                ORACLES[name] = f"{head} {ctes}\n{body}"
            else:
                ORACLES[name] = f"{head} {ctes},\n{body}"
        return fn

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    """Rounded double, so that summation order cannot show."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")
