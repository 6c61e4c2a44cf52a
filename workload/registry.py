"""Collects queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import pyspark.cloudpickle as cloudpickle
from pyspark.sql import DataFrame, SparkSession

import workload
from sightlake.session import prepare

# functions of these modules travel to Python workers with the task
cloudpickle.register_pickle_by_value(workload)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *ctes: str, sql: str | None = None, recursive: bool = False):
    """Register a query; ``sql`` is its twin on top of the given CTEs."""

    def add(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(prepare(spark), sf.rstrip("/"))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            head = ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n" if ctes else ""
            ORACLES[name] = head + sql
        return fn

    return add
