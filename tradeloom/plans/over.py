"""Queries over named tables and fixtures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import frame

Query = Callable[[SparkSession, str], DataFrame]


def over(*names: str) -> Callable[[Callable[..., DataFrame]], Query]:
    """A query that reads the named tables and fixtures."""

    def wrap(f: Callable[..., DataFrame]) -> Query:
        return lambda spark, sf_dir: f(*[frame(spark, sf_dir, n) for n in names])

    return wrap
