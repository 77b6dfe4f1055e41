"""Sources and sinks: article feeds, event frames, index tables and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

from corpusq.operators.relevance import is_relevant

ENTRY = StructType([StructField(n, StringType()) for n in ("title", "link", "ticker", "full_text")])
FEED = MapType(StringType(), ArrayType(ENTRY))


def parse_feed(json: Column) -> Column:
    return F.from_json(json, FEED)


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Raw articles of a feed {key: [{title, link, ticker?, full_text}]}: file, seq, title, link, ticker, text.

    Duplicates stay, and seq keeps the order: files by name, groups and entries as they stand. A missing ticker is the
    key. A feed file is one JSON object, so it is read whole; many files are read side by side. Large feeds
    belong in JSON lines (:func:`read_feed_lines`), which split.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), parse_feed(F.col("value")).alias("feed"))
    names = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file")).distinct()  # one row a file
    ranks = names.select("file", (F.row_number().over(Window.orderBy("file")) - 1).cast("long").alias("rank"))
    groups = whole.select("file", F.posexplode(F.map_entries("feed")).alias("g", "group"))
    rows = groups.select("file", "g", F.col("group.key").alias("key"), F.posexplode("group.value").alias("e", "x")).join(ranks, "file")
    seq = F.shiftleft("rank", 44) + F.shiftleft(F.col("g").cast("long"), 28) + F.col("e")
    return rows.select("file", seq.alias("seq"), "x.title", "x.link", F.coalesce("x.ticker", "key").alias("ticker"), F.col("x.full_text").alias("text"))


def read_feed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw articles of JSON lines {key?, title, link, ticker?, full_text}: file, seq, title, link, ticker, text.

    Files split, so a large one is many tasks; seq keeps the order of splits and of lines in them.
    """
    rows = spark.read.schema(StructType([StructField("key", StringType()), *ENTRY.fields])).json(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"), "title", "link", F.coalesce("ticker", "key").alias("ticker"), F.col("full_text").alias("text"))


def read_table(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Raw articles from a Parquet table; columns maps seq, title, link, ticker, text to expressions."""
    return spark.read.parquet(path).select(*[F.expr(e).alias(n) for n, e in columns.items()])


def upsert(spark: SparkSession, path: str, rows: DataFrame, key: str = "id") -> str:
    """Write a new version of a keyed table with ``rows`` in place of rows of the same key; returns its path.

    Versions are folders under ``path``; readers keep the version they opened, so nothing is read while it is
    overwritten. An absent table is created.
    """
    old = current_version(spark, path)
    merged = rows if old is None else spark.read.parquet(old).join(rows.select(key), key, "left_anti").unionByName(rows)
    target = f"{path}/v-{(_number(old) + 1) if old else 0:010d}-{uuid.uuid4().hex[:8]}"
    merged.write.parquet(target)
    return target


def _number(path: str) -> int:
    return int(path.rstrip("/").rsplit("/v-", 1)[1].split("-")[0])


def current_version(spark: SparkSession, path: str) -> str | None:
    """The newest complete version's folder."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return None
    done = [str(s.getPath()) for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return max(done, default=None, key=_number)


def lookup(table: DataFrame, ids: DataFrame, field: str, key: str = "id") -> DataFrame:
    """One projected field of the rows with the given ids."""
    return table.select(key, field).join(ids.select(key), key, "left_semi")


def sse(event: Column, body: Column) -> Column:
    """One server-sent event frame of a name and a struct."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(body), F.lit("\n\n"))


def parse_sse(stream: Column) -> Column:
    """array<struct<event,data>> of a text of frames; a last frame without its blank line is left out.

    CRLF counts as LF, comment lines are skipped, several data lines are joined, one space after the colon goes.
    """
    text = F.regexp_replace(stream, r"\r\n?", "\n")
    frames = F.split(text, "\n\n")
    whole = F.slice(frames, F.lit(1), F.greatest(F.size(frames) - 1, F.lit(0)))

    def field(frame: Column, name: str) -> Column:
        lines = F.filter(F.split(frame, "\n"), lambda x: x.startswith(f"{name}:"))
        return F.transform(lines, lambda x: F.regexp_replace(x, f"^{name}: ?", ""))

    parsed = F.transform(whole, lambda f: F.struct(F.coalesce(F.try_element_at(field(f, "event"), F.lit(-1)), F.lit("message")).alias("event"), F.array_join(field(f, "data"), "\n").alias("data")))
    return F.filter(parsed, lambda x: x["data"] != "")


REPORT_HEAD = "| Title | Type | Primary | Mentioned | Events | Tone | Salience | Stub |\n|-|-|-|-|-|-|-|-|"


def relevance_report(articles: DataFrame, top: int = 3) -> DataFrame:
    """section, title, line: a Markdown audit, a row per line; articles by title, then those without a primary company.

    Articles: title, article_type, primary_tickers, mentioned_tickers, event_types, sentiment, salience
    (map), is_stub. The head lines sort in front of their section.
    """
    best = F.slice(F.array_sort(F.transform(F.map_entries("salience"), lambda x: F.struct((-x["value"]).alias("s"), x["key"].alias("t")))), 1, top)
    cells = [F.regexp_replace("title", r"\|", "/"), F.col("article_type"), F.array_join("primary_tickers", ", "), F.array_join("mentioned_tickers", ", "), F.array_join("event_types", ", "), F.col("sentiment"), F.array_join(F.transform(best, lambda x: F.format_string("%s %.2f", x["t"], -x["s"])), ", "), F.when(F.col("is_stub"), "yes").otherwise("")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(c, F.lit("")) for c in cells]), F.lit(" |"))
    spark = articles.sparkSession
    heads = spark.createDataFrame([(0, "", REPORT_HEAD), (1, "", "\n## Without a primary company")], "section int, title string, line string")
    rows = articles.select(F.lit(0).alias("section"), "title", line.alias("line"))
    bare = articles.where(~is_relevant(F.col("primary_tickers"))).select(F.lit(1).alias("section"), "title", F.concat(F.lit("- "), F.col("title")).alias("line"))
    return heads.union(rows).union(bare)


def write_report(report: DataFrame, path: str) -> None:
    """The report as text, in order; the sort is distributed, so the parts in order are the report."""
    report.repartitionByRange("section", "title").sortWithinPartitions("section", "title", "line").select("line").write.text(path)


def run_log(answers: DataFrame, latency_ms: int | None = None) -> DataFrame:
    """question_id, line: one JSON line per answered question (see the online plan), with the batch's latency."""
    fields = [F.col("question").alias("query"), "intent", "tickers", "route", F.col("chunk_ids").alias("retrieved_chunk_ids"), F.lit(latency_ms).cast("long").alias("latency_ms"), F.col("tokens").alias("output_tokens"), F.col("removed").alias("removed_sentences"), (F.col("route") == "out_of_scope").alias("out_of_scope")]
    return answers.select("question_id", F.to_json(F.struct(*fields)).alias("line"))
