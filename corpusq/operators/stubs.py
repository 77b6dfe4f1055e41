"""Stub classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusq import config as C
from corpusq.functions.text import word_count


def stub_reason(text: Column, truncation_markers: Column, min_words: int = C.MIN_WORDS) -> Column:
    """truncated if a marker was seen, too_short under ``min_words`` words, else null."""
    return F.when(F.size(truncation_markers) > 0, "truncated").when(word_count(text) < min_words, "too_short")
