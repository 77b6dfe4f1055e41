"""Incremental index: content hashes, what to write, what to delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(text: Column, metadata: Column, is_stub: Column) -> Column:
    """SHA-256 over text, metadata as JSON and the stub flag."""
    return F.sha2(F.concat(text, F.to_json(metadata), is_stub.cast("string")), 256)


def sync_plan(stored: DataFrame, current: DataFrame) -> DataFrame:
    """id, action (write, unchanged or delete) of tables (id, hash); one full join on the id."""
    s, c = stored.select("id", F.col("hash").alias("old")), current.select("id", F.col("hash").alias("new"))
    action = F.when(F.col("new").isNull(), "delete").when(F.col("old").eqNullSafe(F.col("new")), "unchanged").otherwise("write")
    return s.join(c, "id", "full").select("id", action.alias("action"))


def sync_report(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_if(F.col("action") == "write").alias("written"), F.count_if(F.col("action") == "unchanged").alias("unchanged"), F.count_if(F.col("action") == "delete").alias("stale_removed"))


def sync(stored: DataFrame, current: DataFrame) -> DataFrame:
    """The table after a sync: changed and new rows from ``current``, unchanged rows kept as stored, stale rows gone."""
    same = stored.join(current.select("id", "hash"), ["id", "hash"], "left_semi")
    return same.unionByName(current.join(stored.select("id", "hash"), ["id", "hash"], "left_anti"))


def is_ready(path: str, spark) -> bool:
    """Whether an index table exists at the path and holds a row."""
    try:
        return not spark.read.parquet(path).limit(1).isEmpty()
    except Exception as e:  # a missing path is an empty index
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
