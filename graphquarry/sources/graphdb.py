"""Queries that are kept with an application, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def list_queries(stored: DataFrame) -> DataFrame:
    return stored.orderBy("app", "order")


def upsert_queries(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``stored`` with the queries of the apps in ``new`` replaced: changed ones are updated, obsolete ones go, other apps' stay."""
    return stored.join(new.select("app").distinct(), "app", "left_anti").unionByName(new)


def may_store(repositories: DataFrame, stored: DataFrame, app: str, repo: str) -> bool:
    """Whether a load writes the app's queries: its repository is the largest, or there are none yet."""
    largest = repositories.filter((F.col("app") == app) & F.col("symbols").isNotNull()).orderBy(F.desc("symbols"), "name").limit(1).collect()
    return bool(largest and largest[0]["name"] == repo) or stored.filter(F.col("app") == app).isEmpty()
