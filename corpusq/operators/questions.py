"""Question analysis and routing over a table of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq import config as C
from corpusq.operators.mentions import find_tickers


def validate(question: Column) -> tuple[Column, Column]:
    """(question with white space collapsed, problem: blank, too_long or null)."""
    q = F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"(?U)\s+", " "))
    return q, F.when(q == "", "blank").when(F.length(q) > C.QUESTION_CHARS, "too_long")


def intent(question: Column) -> Column:
    out = F.lit("news")
    for name, pattern in reversed(C.INTENTS):
        out = F.when(question.rlike(f"(?i){pattern}"), name).otherwise(out)
    return out


def live_metric(question: Column) -> Column:
    out = F.lit("share price")
    for name, pattern in reversed(C.LIVE_METRICS):
        out = F.when(question.rlike(f"(?i)(?:{pattern})"), name).otherwise(out)
    return out


def analyze(questions: DataFrame, text_col: str = "question") -> DataFrame:
    """The questions with intent, tickers, live_metric (live_data only) and clearly_in_scope."""
    q = F.trim(F.col(text_col))
    out = questions.withColumn("intent", intent(q)).withColumn("tickers", find_tickers(q))
    return out.withColumn("live_metric", F.when(F.col("intent") == "live_data", live_metric(q))).withColumn("clearly_in_scope", (F.size("tickers") > 0) | q.rlike(f"(?i){C.FINANCE}"))


def route(plans: DataFrame, reports: DataFrame, in_scope: Column | None = None) -> DataFrame:
    """Plans (question_id, intent, tickers, clearly_in_scope) with a route, decided by the first rule that applies.

    reports: ticker, level; a ticker without a row counts as none. ``in_scope`` stands for a guard that is asked about
    unclear questions only; where it has no answer (null, as after an error) or there is no guard, they are let
    through. Only ``retrieve`` rows need a search.
    """
    named = plans.select("question_id", F.explode("tickers").alias("ticker")).join(reports.select("ticker", "level"), "ticker", "left")
    none = named.groupBy("question_id").agg(F.min(F.coalesce(F.col("level"), F.lit("none")) == "none").alias("all_none"))
    asked = F.when(~F.col("clearly_in_scope"), in_scope if in_scope is not None else F.lit(True))
    how = (
        F.when(~F.coalesce(asked, F.lit(True)), "out_of_scope")
        .when((F.col("intent") == "timing") & (F.size("tickers") == 0), "timing")
        .when(F.col("intent") == "live_data", "live_data")
        .when(F.coalesce("all_none", F.lit(False)), "not_covered")
        .otherwise("retrieve")
    )
    return plans.join(none, "question_id", "left").withColumn("route", how).drop("all_none")


def live_data_notice(company: Column, metric: Column) -> Column:
    subject = F.when(company.isNotNull(), F.concat(company, F.lit("'s current "), metric)).otherwise(F.concat(F.lit("the current "), metric))
    return F.concat(F.lit("I don't have live market data, and the articles don't state "), subject, F.lit(", so I can't give you that figure."))


def timing_answer(most_covered: DataFrame, total: DataFrame) -> DataFrame:
    """One row: the notice on dates, then the most covered companies (place, company, primary_articles) as bullets; total: total_articles."""
    bullet = F.concat(F.lit("- "), F.col("company"), F.lit(": "), F.col("primary_articles").cast("string"), F.lit(" articles"))
    bullets = most_covered.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", bullet.alias("line")))), lambda x: x["line"]), "\n").alias("bullets"))
    head = F.concat(F.lit("Instead, here's what the "), F.col("total_articles").cast("string"), F.lit(" articles cover most:\n"))
    body = F.concat(head, F.col("bullets"), F.lit("\n\nAsk me about any of these companies for a summary of their news."))
    return bullets.crossJoin(total).select(F.concat_ws("\n\n", F.lit(C.NO_DATES), body).alias("text"))  # one row each


def prompt(intent_: Column, question: Column, sources: Column, guidance: Column, system: str, by_intent: dict[str, str]) -> Column:
    """System template, the intent's template (news if it has none), guidance, question and sources as one text."""
    own = F.coalesce(F.create_map(*[F.lit(x) for kv in by_intent.items() for x in kv])[intent_], F.lit(by_intent.get("news", "")))
    return F.concat_ws("\n\n", F.lit(system), own, F.when(guidance != "", guidance), F.concat(F.lit("Question: "), question), F.concat(F.lit("Sources:\n"), sources))
