"""Registry of queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from askloom.plans.bind import Tables, with_tables


@dataclass(frozen=True)
class Entry:
    key: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def query(key: str, needs: str = "", oracle: str | None = None):
    """Register ``build(tables)``. ``needs`` names the derived tables that the SQL refers to."""

    def wrap(build: Callable[[Tables], DataFrame]):
        if key in REGISTRY:
            raise ValueError(f"duplicate query {key}")
        REGISTRY[key] = Entry(key, build, None if oracle is None else with_tables(needs.split(), oracle))
        return build

    return wrap


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: (lambda spark, sf_dir, e=e: e.build(Tables(spark, sf_dir))) for k, e in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: e.oracle for k, e in REGISTRY.items() if e.oracle is not None}


def _load() -> None:
    from askloom.plans import (  # noqa: F401
        accounts,
        conversation,
        corpus,
        crawl,
        extraction,
        ingest,
        related,
        scalars,
        search,
        streams,
        workflow,
    )
