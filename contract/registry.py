"""Registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


# Exact halves round differently in two engines; this odd fraction of a unit moves them off the edge.
NUDGE = 0.017320508075688773


def settle(df: DataFrame, digits: int) -> DataFrame:
    """Round doubles so that two engines' summation orders compare equal."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`") + NUDGE * 10.0**-digits, digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


def settled_sql(sql: str, doubles: str, digits: int) -> str:
    names = doubles.split()
    if not names:
        return sql
    swaps = ", ".join(f'round("{n}" + {NUDGE * 10.0**-digits!r}::double, {digits}) + 0e0 as "{n}"' for n in names)
    return f"select * replace ({swaps}) from ({sql}) as whole_result"


def query(sql: str | None = None, doubles: str = "", digits: int = 6) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL if it can be said in SQL."""

    def register(run: Query) -> Query:
        QUERIES[run.__name__] = lambda spark, sf: settle(run(spark, sf), digits)
        if sql is not None:
            ORACLES[run.__name__] = settled_sql(sql, doubles, digits)
        return run

    return register
