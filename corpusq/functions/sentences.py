"""Sentence segmentation with offsets (our own rules), as plain functions and as an Arrow function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

_END = re.compile(r"""[.!?]+["')\]]*(?=\s|$)|\n+""")
_ABBREVIATION = re.compile(r"(?:\b(?:Mr|Mrs|Ms|Dr|Prof|St|Jr|Sr|Inc|Corp|Co|Ltd|vs|etc|e\.g|i\.e|No|U\.S|U\.K|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)|\b[A-Z])\.$")


def spans(text: str) -> list[tuple[int, int]]:
    """Start and end of each sentence, trimmed; no character but white space lies outside.

    A sentence ends at ``.!?`` (with closing quotes and brackets) before white space, or at a line end; not after
    an abbreviation or an initial, unless the text ends there.
    """
    out, start = [], 0
    for m in _END.finditer(text):
        if m.group().startswith(".") and m.group() == "." and m.end() < len(text) and _ABBREVIATION.search(text, max(0, m.end() - 12), m.end()):
            continue
        out.append((start, m.end()))
        start = m.end()
    out.append((start, len(text)))
    trimmed = []
    for a, b in out:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            trimmed.append((a, b))
    return trimmed


def split(text: str) -> list[str]:
    return [text[a:b] for a, b in spans(text)]


@F.pandas_udf(ArrayType(StringType()))
def _split_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: split(t or ""))


@F.pandas_udf(ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())])))
def _spans_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": a, "end": b} for a, b in spans(t or "")])


def sentences(text: Column) -> Column:
    """array<string>; empty for null or blank text."""
    return _split_udf(text)


def sentence_spans(text: Column) -> Column:
    """array<struct<start,end>> in characters."""
    return _spans_udf(text)
