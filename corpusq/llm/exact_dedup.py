"""Exact deduplication: a 128-bit content hash finds groups, a comparison of bytes confirms them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """128 bits of a text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per distinct text: h, text, group_size, keep_id.

    The key is the hash and the bytes, so rows of one hash stay apart where their bytes differ. The aggregation
    is partial on the map side, so a text that fills a third of the table leaves each task as one row.
    """
    pick = F.max if keep == "max" else F.min
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.withColumn("h", hash_fn(F.col("text"))).groupBy("h", "text").agg(F.count(F.lit(1)).alias("group_size"), pick("doc_id").alias("keep_id"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty; texts are compared whole, however long. The row with the largest id stays
    (``keep="min"``: the smallest). A null id is kept only if its whole group has null ids. A document is an id
    with a text: rows that repeat both are read and counted in ``group_size``, and have one output row; one id
    with two texts has two. An empty table gives an empty result. Further columns, whatever their names, are ignored.

    Groups are made on the 128-bit hash and then the bytes, so a collision cannot merge texts. A document finds
    its group by that hash and the SHA-256 that its row shows, which is what spares a second shuffle of all texts.
    """
    groups = exact_groups(docs, id_col, text_col, keep, hash_fn)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), hash_fn(text).alias("h"), F.sha2(text.cast("binary"), 256).alias("text_sha256")).distinct()
    found = groups.select("h", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "group_size", "keep_id")
    return rows.join(found, ["h", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The kept rows with all their columns; the same decisions as :func:`exact_dedup`, in one shuffle.

    A null text is compared as empty and stays null if its row stays. Ids may be of any type that has an order, and
    columns have any names; rows that repeat an id and a text leave one.
    """
    others = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(others)], F.col(text_col).isNull().alias("null"))
    rank = F.struct((F.col(id_col).isNotNull() if keep == "max" else F.col(id_col).isNull()).alias("known"), F.col(id_col).alias("id"))
    best = (F.max_by if keep == "max" else F.min_by)("row", "rank").alias("row")
    kept = docs.select(content_hash(text).alias("h"), text.alias("text"), rank.alias("rank"), row.alias("row")).groupBy("h", "text").agg(best)
    back = {c: F.col("row")[f"c{i}"] for i, c in enumerate(others)} | {text_col: F.when(~F.col("row")["null"], F.col("text"))}
    return kept.select(*[back[c].alias(c) for c in docs.columns])
