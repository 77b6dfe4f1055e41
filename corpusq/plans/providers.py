"""Ports for embeddings and language models, with deterministic offline defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.functions.text import let, words

DIMENSION = 64


def hashed_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """A unit vector of word counts in hashed buckets: the default in place of an embedding service."""
    bucket = lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"), F.lit(dimension))
    every = F.sequence(F.lit(0).cast("long"), F.lit(dimension - 1).cast("long"))
    counts = lambda buckets: F.transform(every, lambda i: (F.size(buckets) - F.size(F.array_remove(buckets, i))).cast("double"))
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda c: let(norm(c), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0)))
    return let(let(F.transform(words(text), bucket), counts), unit)


class EmbeddingError(RuntimeError):
    """What an embedding service raises when it cannot encode."""


def encode_hashed(rows: DataFrame) -> DataFrame:
    """id, vector, error (null) of rows (id, text), by the default embedding; an encoder of another kind has the same shape."""
    return rows.select("id", hashed_embedding(F.coalesce("text", F.lit(""))).alias("vector"), F.lit(None).cast("string").alias("error"))


def encoder(embed: Callable[[list[str]], list[list[float]]], batch: int = 64) -> Callable[[DataFrame], DataFrame]:
    """An encoder from a function over lists of texts, called with ``batch`` texts at most, in order.

    If it raises EmbeddingError, the rows of that call have its message in ``error`` and no vector.
    """

    def encode(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, batch):
                    part = whole.slice(at, batch)
                    try:
                        vectors, said = embed([t or "" for t in part.column(1).to_pylist()]), None
                    except EmbeddingError as e:
                        vectors, said = [None] * part.num_rows, str(e)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64())), pa.array([said] * part.num_rows, pa.string())], ["id", "vector", "error"])

        return rows.select("id", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, vector array<double>, error string")

    return encode


def extractive_answer(requests: DataFrame, sentences: int = 1) -> DataFrame:
    """question_id, draft, error (null), tokens: the first sentences of each source with its citation; the default in place of a model.

    Requests: question_id, prompt, sources (array of number, text). A model reads the prompt.
    """
    from corpusq.functions.sentences import sentences as split

    each = requests.select("question_id", F.explode("sources").alias("s")).select("question_id", "s.number", split(F.col("s.text")).alias("parts"))
    line = F.concat(F.array_join(F.slice("parts", 1, sentences), " "), F.lit(" ["), F.col("number").cast("string"), F.lit("]"))
    drafts = each.select("question_id", "number", line.alias("line")).groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", "line"))), lambda x: x["line"]), "\n").alias("draft"))
    return drafts.select("question_id", "draft", F.lit(None).cast("string").alias("error"), F.size(words(F.col("draft"))).alias("tokens"))
