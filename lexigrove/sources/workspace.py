"""Where a session keeps what it writes for itself."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import SparkSession


@lru_cache(1)
def _own() -> str:
    return "file://" + tempfile.mkdtemp(prefix="lexigrove-")


def folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: under spark.checkpoint.dir, or where that is unset and all runs in one
    process (as in tests), a temporary one. On a cluster an unset one raises."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or _own()).rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path under folder() that nothing has used."""
    return f"{folder(spark)}/lexigrove/{name}-{uuid.uuid4().hex}"


#: Has Spark delete a query's shuffle files when the query is done; else they stay until the driver's heap happens to be collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
