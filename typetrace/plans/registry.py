"""Every registered query: name, the function that builds it, and its SQL twin if there is one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    name: str
    ids: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(ids: str, sql: str | None = None):
    """Register the decorated function under its own name; ``ids`` are the survey's numbers."""

    def wrap(fn):
        assert fn.__name__ not in REGISTRY, fn.__name__
        REGISTRY[fn.__name__] = Query(fn.__name__, ids, fn, sql)
        return fn

    return wrap
