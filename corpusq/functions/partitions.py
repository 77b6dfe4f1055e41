"""Partitions for scans that keep a core busy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Estimated bytes per core up to which an input counts as small.
SMALL = 2 << 20
#: Rows of an Arrow batch at most: a worker holds a batch of texts and what becomes of it.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds: 10,000 rows, Spark's default, are never full on small inputs and always on large ones."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))


def spread(df: DataFrame) -> DataFrame:
    """A small input over all cores, as one file with one row group is one task; a larger input stays as it is.

    The size is the planner's estimate; nothing runs. So only inputs of a few megabytes a core are shuffled.
    Python functions over it get small batches.
    """
    small_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * SMALL else df
