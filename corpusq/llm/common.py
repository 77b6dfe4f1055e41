"""What the operators of this subpackage share: reading, checkpoints, shipping of code."""

from __future__ import annotations

import os
import tempfile
import zipfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.functions.lineage import checkpoint, shared_folder

__all__ = ["BATCH_ROWS", "Words", "checkpoint", "fold", "mix64", "read", "shared_folder", "ship"]

_SHIPPED: set[str] = set()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch at most: texts can be long, and a worker holds a batch or two.
BATCH_ROWS = 1000


def ship(spark: SparkSession) -> None:
    """Make this package importable on every executor, once per application, and keep Arrow batches small."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="corpusq")), "corpusq_src.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(os.path.join(root, "corpusq")):
            for n in names:
                if not n.endswith(".pyc"):
                    p = os.path.join(folder, n)
                    z.write(p, os.path.relpath(p, root))
    spark.sparkContext.addPyFile(out)
    _SHIPPED.add(app)


def fold(id_col: str) -> Column:
    """crc32 of the id's text modulo 5; 0 marks the held-out fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two xor-multiply rounds); uint64 in, uint64 out."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Words(dict):
    """Word (bytes) -> row number, handing out the next number to a new word.

    One instance serves one Arrow batch, so its size is bounded by the batch.
    """

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n
