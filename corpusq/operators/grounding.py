"""Answer verification: every sentence needs a known citation, every figure a cited source that has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq import config as C
from corpusq.functions import sentences as S
from corpusq.functions import text as T

BULLET = r"(?U)^(\s*(?:[-*]|\d+\.)\s+)"
_BREAK, _CITED = "\x01", r"(?:\s*\[\d+\])+"


def line_sentences(line: Column) -> Column:
    """Sentences of a line (array<string>); citations at a sentence's start belong to the sentence before.

    The sentences stand in one string with a mark between any two: a mark in front of nothing but citations
    becomes a space, and a mark in front of citations and words moves behind the citations.
    """
    whole = F.array_join(S.sentences(line), _BREAK)
    joined = F.regexp_replace(whole, rf"{_BREAK}(?={_CITED}\s*(?:{_BREAK}|$))", " ")
    moved = F.regexp_replace(joined, rf"{_BREAK}\s*({_CITED})\s*", rf" $1{_BREAK}")
    return F.filter(F.transform(F.split(moved, _BREAK), F.trim), lambda s: s != "")


def answer_lines(answers: DataFrame) -> DataFrame:
    """answer_id, line_no, line of answers (answer_id, text)."""
    lines = F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n")
    return answers.select("answer_id", F.posexplode(lines).alias("line_no", "line"))


def answer_sentences(lines: DataFrame) -> DataFrame:
    """answer_id, line_no, prefix (bullet), blank, sentence_no (null in blank lines), sentence. Lines: answer_id, line_no, line."""
    folded = lines.withColumn("line", T.fold_punctuation(F.col("line")))
    parts = folded.select("answer_id", "line_no", F.regexp_extract("line", BULLET, 1).alias("prefix"), (F.trim("line") == "").alias("blank"), F.regexp_replace("line", BULLET, "").alias("body"))
    return parts.select("answer_id", "line_no", "prefix", "blank", F.posexplode_outer(line_sentences(F.col("body"))).alias("sentence_no", "sentence"))


def source_quantities(sources: DataFrame) -> DataFrame:
    """answer_id, number, quantities: each source read once. Sources: answer_id, number, text."""
    return sources.select("answer_id", "number", T.quantities(F.col("text")).alias("quantities"))


def check_sentences(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """Every sentence of lines (answer_id, line_no, line) with citations, unsupported figures and reason (null: kept, uncited, unsupported_number).

    A source's figures travel with the answer as one small map (answers have a handful of sources).
    """
    known = source_quantities(sources).groupBy("answer_id").agg(F.map_from_entries(F.collect_list(F.struct("number", "quantities"))).alias("figures"))
    rows = answer_sentences(lines).join(known, "answer_id", "left")
    numbers = F.coalesce(F.map_keys("figures"), F.array().cast("array<int>"))
    rows = rows.withColumn("sentence", T.drop_unknown_citations(F.col("sentence"), numbers)).withColumn("cited", F.array_distinct(T.citations(F.col("sentence"))))
    supported = F.flatten(F.transform("cited", lambda n: F.coalesce(F.try_element_at("figures", n), F.array().cast("array<struct<value:decimal(38,12),is_percent:boolean>>"))))
    missing = F.array_except(T.quantities(F.col("sentence")), supported)
    rows = rows.withColumn("unsupported", F.when(F.size("cited") > 0, missing))
    reason = F.when(F.col("sentence").isNull(), None).when((F.size("cited") == 0) & ~T.is_lead_in(F.col("sentence")), "uncited").when(F.size("unsupported") > 0, "unsupported_number")
    return rows.withColumn("reason", reason).drop("figures")


def shown_lines(lines: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, line_no, text (null: nothing of the line may be shown; empty: a paragraph break), cited, gone.

    A line needs nothing but itself and the sources, so lines can be checked as they arrive.
    """
    rows = check_sentences(lines, sources)
    kept = F.col("reason").isNull() & F.col("sentence").isNotNull()
    checked = rows.groupBy("answer_id", "line_no").agg(
        F.first("prefix").alias("prefix"),
        F.first("blank").alias("blank"),
        F.array_sort(F.collect_list(F.when(kept, F.struct("sentence_no", "sentence", "cited")))).alias("kept"),
        F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("sentence_no", "sentence", "reason", "unsupported")))).alias("gone"),
    )
    text = F.when(F.size("kept") > 0, F.concat(F.col("prefix"), F.array_join(F.transform("kept", lambda x: x["sentence"]), " "))).when(F.col("blank"), F.lit(""))
    detail = lambda g: F.array_join(F.array_sort(F.transform(F.coalesce(g["unsupported"], F.array().cast("array<struct<value:decimal(38,12),is_percent:boolean>>")), lambda q: F.concat(F.regexp_replace(q["value"].cast("string"), r"\.?0+$", ""), F.when(q["is_percent"], "%").otherwise("")))), ", ")
    gone = F.transform("gone", lambda g: F.struct(g["sentence"].alias("sentence"), g["reason"].alias("reason"), detail(g).alias("detail")))
    return checked.select("answer_id", "line_no", text.alias("text"), F.flatten(F.transform("kept", lambda x: x["cited"])).alias("cited"), gone.alias("gone"))


def verify(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """answer_id, text (kept sentences, bullets and paragraph breaks), cited_numbers (in order), removed, lines (to show).

    Lines are regrouped by answer; an answer is a small group.
    """
    whole = shown_lines(answer_lines(answers), sources).groupBy("answer_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "text", "cited", "gone"))).alias("lines"))
    shown = F.filter("lines", lambda x: x["text"].isNotNull())
    return whole.select(
        "answer_id",
        F.regexp_replace(F.regexp_replace(F.array_join(F.transform(shown, lambda x: x["text"]), "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "").alias("text"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("lines", lambda x: x["cited"])))).alias("cited_numbers"),
        F.flatten(F.transform("lines", lambda x: x["gone"])).alias("removed"),
        F.transform(shown, lambda x: F.struct(x["line_no"].alias("line_no"), x["text"].alias("text"))).alias("lines"),
    )


def joined(parts: list[Column], sep: str = "\n\n") -> Column:
    """The parts that are neither null nor empty, one after another."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p != ""), sep)


def closing_notices(cites_stub: Column, intent: Column) -> Column:
    return joined([F.when(cites_stub, C.PARTIAL_SOURCES), F.when(intent.isin("advice", "prediction"), C.NOT_ADVICE)])


def final_text(body: Column, before: Column, cites_stub: Column, intent: Column) -> Column:
    """Notices before, the body (or the fixed message if it is empty), notices after."""
    return joined([before, F.when(body != "", body).otherwise(C.NO_GROUNDED_ANSWER), closing_notices(cites_stub, intent)])
