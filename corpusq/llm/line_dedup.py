"""Site-relative line deduplication: drop a line that too large a share of a host's pages contains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import checkpoint

#: A drop list of at most this many rows (about 60 bytes each) is broadcast; a longer one is joined by shuffle.
BROADCAST_ROWS = 100_000


def bare(line: Column) -> Column:
    """A line without white space at its ends (space, tab, carriage return, line and form feeds, vertical tab)."""
    return F.regexp_replace(line, r"^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$", "")


def line_key(line: Column) -> Column:
    """128 bits of a bare line, as text, which Spark's array functions hash."""
    return F.md5(line.cast("binary"))


def boilerplate_lines(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """host, line_key, pages, host_pages, ratio of every line on more than ``ratio`` of its host's pages.

    A line must also occur on ``min_pages`` pages at least, so that hosts of a few pages keep their text: on a host of
    ten pages every line is on a tenth of them. Lines are compared without white space at their ends; lines of white
    space never count. A page counts once however often it repeats a line. Null hosts form one host. Both
    aggregations combine on the map side, so a hot host or a hot line leaves each task as one row.
    """
    pages = docs.select(F.coalesce(F.col(host_col), F.lit("")).alias("host"), F.col(text_col).alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = F.filter(F.array_distinct(F.transform(F.split(F.col("text"), "\n"), bare)), lambda x: x != "")
    counts = pages.select("host", F.explode(F.transform(lines, line_key)).alias("line_key")).groupBy("host", "line_key").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    return counts.join(totals, "host").withColumn("ratio", F.col("pages") / F.col("host_pages")).where(F.col("ratio") > ratio)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", ratio: float = 0.05, min_pages: int = 5) -> DataFrame:
    """One row per document: doc_id, host, text (boilerplate lines dropped), n_lines, n_dropped.

    Null text counts as empty (one empty line). Lines of white space stay. Texts are read whole, however long.
    Repeated rows are separate pages and each gives a row; ids may be null. An empty table gives an empty result;
    further columns, whatever their names, are ignored.

    A line on more than a share r of a host's pages takes up r of the host's lines, so a host has at most
    (lines per page) / r dropped lines; they are gathered per host, and the list is broadcast only where its
    measured length is within BROADCAST_ROWS. Beyond it, documents meet their host's list in a shuffle join,
    whose large partitions Spark splits, as the other side has one row per host. A page first finds which of the
    list's lines it has (by hashing), so its lines are looked up among those few.
    """
    drops = checkpoint(boilerplate_lines(docs, host_col, text_col, ratio, min_pages).select("host", "line_key"))
    lists = drops.groupBy("host").agg(F.collect_list("line_key").alias("drop"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(host_col), F.lit("")).alias("host"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if drops.count() <= BROADCAST_ROWS:
        lists = F.broadcast(lists)
    rows = rows.join(lists, "host", "left").withColumn("lines", F.split("text", "\n")).withColumn("keys", F.when(F.col("drop").isNotNull(), F.transform("lines", lambda x: line_key(bare(x)))))
    rows = rows.withColumn("here", F.array_intersect("keys", "drop"))
    kept = F.when(F.coalesce(F.size("here"), F.lit(0)) <= 0, F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains(F.col("here"), F.get(F.col("keys"), i))))
    return rows.withColumn("kept", kept).select("doc_id", "host", F.array_join("kept", "\n").alias("text"), F.size("lines").alias("n_lines"), (F.size("lines") - F.size("kept")).alias("n_dropped"))
