"""Registry of named queries: a Spark builder and, where SQL can state the
same result, a DuckDB oracle text over the driver tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class NamedQuery:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None
    operators: tuple[str, ...] = field(default_factory=tuple)


QUERIES: dict[str, NamedQuery] = {}


def register(name: str, oracle: str | None = None, operators: tuple[str, ...] = ()):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = NamedQuery(name, fn, oracle, operators)
        return fn
    return deco
