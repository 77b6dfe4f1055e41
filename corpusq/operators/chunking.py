"""Context-labelled chunks of articles."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq import config as C
from corpusq.functions import sentences as S
from corpusq.functions.partitions import spread
from corpusq.functions.text import chunk_id
from corpusq.operators.mentions import display_name

_TOKEN = re.compile(r"\w+|[^\w\s]")


def count_tokens(text: str) -> int:
    """The default counter: words and marks. Another can be passed to :func:`chunk`."""
    return len(_TOKEN.findall(text))


def header(title: Column, primary: Column, mentioned: Column, is_stub: Column) -> Column:
    """Title, companies and the note on partial articles, one a line; empty lines are left out."""
    names = lambda c: F.array_join(F.transform(c, lambda t: F.concat(display_name(t), F.lit(" ("), t, F.lit(")"))), ", ")
    line = lambda label, c: F.when(F.size(c) > 0, F.concat(F.lit(label), names(c)))
    return F.concat_ws("\n", F.concat(F.lit("Title: "), title), line("About: ", primary), line("Also mentions: ", mentioned), F.when(is_stub, C.STUB_NOTE))


def packed(units: list[str], sizes: list[int], budget: int, overlap: int, size: Callable[[list[str], list[int]], int]) -> Iterator[list[str]]:
    """Runs of units whose joint size is within the budget; each repeats the last ``overlap`` units of the one before if there is room."""
    first = 0
    for i in range(1, len(units) + 1):
        if i < len(units) and size(units[first : i + 1], sizes[first : i + 1]) <= budget:
            continue
        yield units[first:i]
        if i < len(units):
            again = max(first, i - overlap)
            first = again if size(units[again : i + 1], sizes[again : i + 1]) <= budget else i


def pieces(text: str, budget: int, overlap: int, count: Callable[[str], int], additive: bool = False) -> list[str]:
    """The text whole if it fits, else sentences packed greedily, sentences over the budget split by words.

    ``additive``: the size of units joined by spaces is the sum of theirs, as for the default counter; each unit is then
    counted once. Other counters see the joined text again.
    """
    if count(text) <= budget:
        return [text]
    size = (lambda units, sizes: sum(sizes)) if additive else (lambda units, sizes: count(" ".join(units)))
    units: list[str] = []
    for s in S.split(text):
        if count(s) <= budget:
            units.append(s)
        else:
            words = s.split()
            units.extend(" ".join(run) for run in packed(words, [count(w) for w in words], budget, 0, size))
    return [" ".join(run) for run in packed(units, [count(u) for u in units], budget, overlap, size)]


def chunk(articles: DataFrame, max_tokens: int = C.CHUNK_TOKENS, overlap: int = C.CHUNK_OVERLAP, count: Callable[[str], int] = count_tokens) -> DataFrame:
    """article_id, chunk_index, chunk_id, header, text, contextualized_text.

    Articles: article_id, title, text, primary_tickers, mentioned_tickers, is_stub.
    """
    head = spread(articles).select("article_id", header(F.col("title"), F.col("primary_tickers"), F.col("mentioned_tickers"), F.col("is_stub")).alias("header"), "text")
    additive = count is count_tokens

    @F.arrow_udf("array<string>")
    def cut(headers: pa.Array, texts: pa.Array) -> pa.Array:
        rows = zip(headers.to_pylist(), texts.to_pylist(), strict=True)
        return pa.array([pieces(t or "", max_tokens - count(h + "\n\n"), overlap, count, additive) for h, t in rows], pa.list_(pa.string()))

    out = head.select("article_id", "header", F.posexplode(cut("header", "text")).alias("chunk_index", "text"))
    return out.withColumn("chunk_id", chunk_id(F.col("article_id"), F.col("chunk_index"))).withColumn("contextualized_text", F.concat_ws("\n\n", "header", "text"))
