"""The stored index: chunks, their vectors and their postings, in versions; readers keep the version they opened."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.functions.lineage import delete_folder
from corpusq.functions.text import words
from corpusq.operators import index, search
from corpusq.plans import providers
from corpusq.sources.feeds import _number, current_version

CHUNK = "id string, article_id string, chunk_index int, hash string, title string, link string, header string, text string, contextualized_text string, is_stub boolean, primary_tickers array<string>, mentioned_tickers array<string>, event_types array<string>, sentiment string, article_type string"
Encode = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Index:
    """chunks (payload, doc_len), vectors (id, vector) and postings (term, id, tf)."""

    chunks: DataFrame
    vectors: DataFrame
    postings: DataFrame


def build(chunks: DataFrame, encode: Encode = providers.encode_hashed) -> Index:
    """An index of chunks. A text that cannot be encoded stops the job with the encoder's message (an EmbeddingError)."""
    tokens = chunks.select("id", words(F.coalesce("contextualized_text", F.lit(""))).alias("t"))
    lengths = tokens.select("id", F.size("t").alias("doc_len"))
    vectors = encode(chunks.select("id", F.col("contextualized_text").alias("text")))
    vector = F.when(F.col("error").isNull(), F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("EmbeddingError: "), F.col("error"))))
    terms = tokens.select("id", F.explode("t").alias("term")).groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    return Index(chunks.join(lengths, "id"), vectors.select("id", vector.alias("vector")), terms)


def empty(spark: SparkSession) -> Index:
    none = lambda schema: spark.createDataFrame([], schema)
    return Index(none(f"{CHUNK}, doc_len int"), none("id string, vector array<double>"), none("term string, id string, tf long"))


def load(spark: SparkSession, path: str) -> Index:
    """The newest complete version; an absent index is empty."""
    folder = current_version(spark, path)
    if folder is None:
        return empty(spark)
    return Index(*(spark.read.parquet(f"{folder}/{t}") for t in ("chunks", "vectors", "postings")))


def sync(spark: SparkSession, path: str, chunks: DataFrame, encode: Encode = providers.encode_hashed) -> DataFrame:
    """Write the next version with ``chunks`` (id, hash and more); returns the report (written, unchanged, stale_removed).

    Only new and changed chunks are encoded and tokenised; the rest is taken over, stale chunks stay behind. Postings are
    written in order of their terms, so a query's terms meet few row groups.
    """
    old, old_folder = load(spark, path), current_version(spark, path)
    plan = index.sync_plan(old.chunks, chunks)
    same = plan.where("action = 'unchanged'").select("id")
    new = build(chunks.join(plan.where("action = 'write'").select("id"), "id", "left_semi"), encode)
    target = f"{path}/v-{(_number(old_folder) + 1) if old_folder else 0:010d}-{uuid.uuid4().hex[:8]}"
    for name in ("chunks", "vectors", "postings"):
        kept = getattr(old, name).join(same, "id", "left_semi")
        rows = kept.unionByName(getattr(new, name), allowMissingColumns=True)
        (rows.repartition("term").sortWithinPartitions("term") if name == "postings" else rows).write.parquet(f"{target}/{name}")
    jvm = spark._jvm.org.apache.hadoop.fs
    done = jvm.Path(f"{target}/_SUCCESS")
    done.getFileSystem(spark._jsc.hadoopConfiguration()).create(done).close()
    return index.sync_report(plan)


def drop_versions_before(spark: SparkSession, path: str, keep: str) -> None:
    """Delete complete versions older than ``keep``, for when no reader holds one."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    for s in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root):
        if _number(str(s.getPath())) < _number(keep):
            delete_folder(spark, str(s.getPath()))


def health(spark: SparkSession, path: str) -> dict[str, object]:
    """status (ok, degraded), store (up, down) and index_ready, as plain values."""
    try:
        folder = current_version(spark, path)
        ready = folder is not None and index.is_ready(f"{folder}/chunks", spark)
        return {"status": "ok" if ready else "degraded", "store": "up", "index_ready": ready}
    except Exception:  # noqa: BLE001 - whatever keeps the store from being read
        return {"status": "degraded", "store": "down", "index_ready": False}


def to_payload(rows: DataFrame) -> DataFrame:
    """id, payload: everything else as one JSON text."""
    return rows.select("id", F.to_json(F.struct(*[c for c in rows.columns if c != "id"])).alias("payload"))


def from_payload(rows: DataFrame, schema: str = CHUNK) -> DataFrame:
    """The rows again; fields that the schema does not know are ignored, missing ones are null."""
    fields = ", ".join(f for f in schema.split(", ") if not f.startswith("id "))
    return rows.select("id", F.from_json("payload", fields).alias("p")).select("id", "p.*")


def sparse_scores(index_: Index, queries: DataFrame) -> DataFrame:
    """query_id, id, score of all chunks with a query term; statistics are the whole index's. Queries: query_id, query."""
    return search.bm25_postings(index_.postings, index_.chunks.select("id", "doc_len"), queries)
