"""Named queries over the given tables, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import apply_settings
from .fixtures import Tables

DIGITS = 4
_TYPES = {"l": ("bigint", "BIGINT"), "s": ("string", "VARCHAR"), "b": ("boolean", "BOOLEAN"), "d": ("double", "DOUBLE")}


@dataclass(frozen=True)
class Query:
    name: str
    columns: tuple[tuple[str, str], ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        df = self.build(Tables(apply_settings(spark), folder))
        out = []
        for name, kind in self.columns:
            c = F.col(name).cast(_TYPES[kind][0])
            out.append((F.round(c, DIGITS) + F.lit(0.0) if kind == "d" else c).alias(name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        out = []
        for name, kind in self.columns:
            c = f"CAST({name} AS {_TYPES[kind][1]})"
            out.append(f"{f'round({c}, {DIGITS}) + 0.0' if kind == 'd' else c} AS {name}")
        return f"SELECT {', '.join(out)} FROM ({self.sql}) AS q"


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str, sql: str | None = None):
    """Register ``build``; ``columns`` is ``name:type`` with l, s, b or d (doubles are rounded)."""
    pairs = tuple(tuple(c.split(":")) for c in columns.split())

    def add(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, pairs, build, sql)
        return build

    return add
