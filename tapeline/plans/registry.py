"""Registry of named queries, each with its output contract and SQL twin.

The contract is a list of `name:type` tokens (s string, i bigint, b boolean, d date,
t timestamp, f double rounded to 4 places, fN double rounded to N places). It is applied
to the Spark result and to the SQL twin alike, so both sides have equal names and types.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import views


@dataclass
class Query:
    name: str
    columns: list[tuple[str, str]]
    build: Callable
    sql: str | None
    uses: tuple[str, ...]


# Prices here are short decimals, so exact rounding ties are common and the two engines
# break them differently; both sides move off the tie by the same small amount.
TIE_SHIFT = 0.0137174211

REGISTRY: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None, uses: str = "bars"):
    cols = []
    for token in columns.split():
        c, _, kind = token.partition(":")
        cols.append((c, kind or "f"))

    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, cols, fn, sql, tuple(uses.split()))
        return fn

    return register


def conform(df: DataFrame, cols: list[tuple[str, str]]) -> DataFrame:
    out = []
    for name, kind in cols:
        c = F.col(name)
        if kind[0] == "f":
            n = int(kind[1:] or 4)
            c = F.round(c.cast("double") + F.lit(TIE_SHIFT * 10.0**-n), n) + F.lit(0.0)
        else:
            c = c.cast({"s": "string", "i": "bigint", "b": "boolean", "d": "date", "t": "timestamp_ntz"}[kind])
        out.append(c.alias(name))
    return df.select(*out)


def conform_sql(body: str, cols: list[tuple[str, str]], uses: tuple[str, ...]) -> str:
    out = []
    for name, kind in cols:
        if kind[0] == "f":
            n = int(kind[1:] or 4)
            out.append(f"round(CAST({name} AS DOUBLE) + {TIE_SHIFT * 10.0**-n!r}, {n}) + 0e0 AS {name}")
        else:
            t = {"s": "VARCHAR", "i": "BIGINT", "b": "BOOLEAN", "d": "DATE", "t": "TIMESTAMP"}[kind]
            out.append(f"CAST({name} AS {t}) AS {name}")
    ctes = "".join(f"{n} AS ({sql}),\n" for n, sql in views.sql_views(uses))
    return f"WITH RECURSIVE {ctes}result AS ({body})\nSELECT {', '.join(out)} FROM result"


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    q = REGISTRY[name]
    return conform(q.build(views.Tables(spark, sf_dir)), q.columns)


def oracle(name: str) -> str | None:
    q = REGISTRY[name]
    return None if q.sql is None else conform_sql(q.sql, q.columns, q.uses)
