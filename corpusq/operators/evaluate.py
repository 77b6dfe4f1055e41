"""Judging and evaluation: votes, faithfulness, recall, expectations, transforms and invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.functions import text as T
from corpusq.operators.grounding import answer_lines, answer_sentences

MIN_QUOTE = 20


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(T.fold_punctuation(text), r"(?U)\s+", " "))


def decide_vote(verdict: Column, quote: Column, cited_texts: Column, least: int = MIN_QUOTE) -> Column:
    """The reason a vote ends with; null verdict: the call failed. Only judge_supported counts for the claim."""
    q = _plain(quote)
    found = F.exists(cited_texts, lambda t: F.contains(_plain(t), q))
    return F.when(verdict.isNull(), "judge_error").when(verdict != "supported", "judge_unsupported").when(F.length(F.coalesce(q, F.lit(""))) < least, "quote_too_short").when(~found, "quote_not_found").otherwise("judge_supported")


def majority(votes: DataFrame, keys: list[str]) -> DataFrame:
    """Per claim: verdict (more than half of the votes), agreement, and the reason; ties of reasons go to the earlier vote.

    Votes: keys, vote_no, reason.
    """
    per = votes.groupBy(*keys, "reason").agg(F.count(F.lit(1)).alias("n"), F.min("vote_no").alias("first"))
    yes = F.coalesce(F.sum(F.when(F.col("reason") == "judge_supported", F.col("n"))), F.lit(0))
    no = F.max_by(F.when(F.col("reason") != "judge_supported", F.col("reason")), F.when(F.col("reason") != "judge_supported", F.struct("n", -F.col("first"))))
    out = per.groupBy(*keys).agg(F.sum("n").alias("votes"), yes.alias("yes"), no.alias("no"))
    ok = F.col("yes") * 2 > F.col("votes")
    return out.select(*keys, F.when(ok, "supported").otherwise("unsupported").alias("verdict"), F.when(ok, "judge_supported").otherwise(F.col("no")).alias("reason"), F.round(F.greatest("yes", F.col("votes") - F.col("yes")) / F.col("votes"), 6).alias("agreement"))


def faithfulness(judgments: DataFrame, case: str = "case_id") -> DataFrame:
    """Per case: judged, supported, score."""
    return judgments.groupBy(case).agg(F.count(F.lit(1)).alias("judged"), F.count_if(F.col("verdict") == "supported").alias("supported")).withColumn("score", F.round(F.col("supported") / F.col("judged"), 6))


def faithfulness_gate(scores: DataFrame, mean: float = 0.8, least: float = 0.6) -> DataFrame:
    """mean_score, min_score, passed; no scores pass."""
    return scores.agg(F.round(F.avg("score"), 6).alias("mean_score"), F.min("score").alias("min_score")).withColumn("passed", F.coalesce((F.col("mean_score") >= mean) & (F.col("min_score") >= least), F.lit(True)))


def recall_at_k(gold: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Per query: distinct gold links, how many are among the first k, recall and the missed ones.

    gold: query_id, link, reviewed; ranked: query_id, link, rank. ``recall_reviewed`` is null without reviewed links.
    """
    g = gold.groupBy("query_id", "link").agg(F.max("reviewed").alias("reviewed"))
    hit = ranked.where(F.col("rank") <= k).select("query_id", "link").distinct().withColumn("hit", F.lit(True))
    j = g.join(hit, ["query_id", "link"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return j.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("gold"),
        F.count_if("hit").alias("found"),
        F.round(F.avg(F.col("hit").cast("double")), 6).alias("recall_all"),
        F.round(F.avg(F.when(F.col("reviewed"), F.col("hit").cast("double"))), 6).alias("recall_reviewed"),
        F.array_sort(F.collect_list(F.when(~F.col("hit"), F.col("link")))).alias("missed"),
    )


def has_term(text: Column, term: str) -> Column:
    """The term as whole tokens, in any case."""
    return text.rlike(rf"(?iU)(?<!\w){T.quote(term)}(?!\w)")


def expectation_problems(text: Column, include: list[str], exclude: list[str], any_of: list[str], figures: list[str], no_figures: list[str]) -> Column:
    """Names of the expectations an answer misses; figures compare by value."""
    have = T.quantities(text)
    hit = lambda f: F.size(F.array_intersect(have, T.quantities(F.lit(f)))) > 0
    bad = [F.when(~has_term(text, t), F.lit(f"missing {t}")) for t in include] + [F.when(has_term(text, t), F.lit(f"unwanted {t}")) for t in exclude]
    bad += [F.when(~hit(f), F.lit(f"missing figure {f}")) for f in figures] + [F.when(hit(f), F.lit(f"unwanted figure {f}")) for f in no_figures]
    if any_of:
        none = F.lit(True)
        for t in any_of:
            none = none & ~has_term(text, t)
        bad.append(F.when(none, F.lit("missing any of " + ", ".join(any_of))))
    return F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")


def counterfactual(passages: DataFrame, old: str, new: str, columns: list[str]) -> DataFrame:
    """Whole-token replacements of ``old`` in the columns, and whether a row was touched."""
    swap = lambda c: F.regexp_replace(c, rf"(?U)(?<!\w){T.quote(old)}(?!\w)", new.replace("\\", "\\\\").replace("$", "\\$"))
    out = passages.withColumns({f"__{c}": swap(F.col(c)) for c in columns})
    touched = F.lit(False)
    for c in columns:
        touched = touched | F.coalesce(F.col(c) != F.col(f"__{c}"), F.lit(False))
    out = out.withColumn("touched", touched)
    for c in columns:
        out = out.withColumn(c, F.col(f"__{c}"))
    return out.drop(*[f"__{c}" for c in columns])


def ablate(passages: DataFrame, links: DataFrame, key: str = "link") -> DataFrame:
    return passages.join(links.select(key), key, "left_anti")


def duplicate_ids(cases: DataFrame, id_col: str) -> DataFrame:
    return cases.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def new_numbers(clean: Column, raw: Column) -> Column:
    """Numbers in the cleaned text that the folded raw text lacks; must be empty."""
    return F.array_except(T.numbers(clean), T.numbers(raw))


#: Fixed value: wording of advice or a forecast in the answer's own voice.
OWN_FORECAST = r"(?i)\b(I (think|believe|expect|predict)|you should (buy|sell)|I recommend|is a (good|great) buy)"


def outcome_problems(expected: Column, text: Column, citations: Column, disclaimer: str) -> Column:
    """abstain: no citations; answer: some; disclaimer: some, the notice at the end and no forecast in its own voice."""
    n = F.size(citations)
    return F.array_compact(
        F.array(
            F.when((expected == "abstain") & (n > 0), F.lit("cites sources")),
            F.when(expected.isin("answer", "disclaimer") & (n == 0), F.lit("cites nothing")),
            F.when((expected == "disclaimer") & ~text.endswith(disclaimer), F.lit("lacks the notice")),
            F.when((expected == "disclaimer") & F.regexp_replace(text, T.quote(disclaimer), "").rlike(OWN_FORECAST), F.lit("forecasts")),
        )
    )


def judged_sentences(answers: DataFrame, sources: DataFrame, fixed: list[str]) -> DataFrame:
    """answer_id, sentence_id, sentence, cited, cited_texts, reason of an answer's sentences.

    Fixed messages are taken out first. reason: ``skipped`` (a lead-in or uncited), ``unknown_citation`` (fails
    without a call) or null (to be judged, with each cited source's text once).
    """
    text = F.col("text")
    for m in fixed:
        text = F.replace(text, F.lit(m), F.lit(""))
    known = sources.groupBy("answer_id").agg(F.map_from_entries(F.collect_list(F.struct("number", "text"))).alias("known"))
    rows = answer_sentences(answer_lines(answers.withColumn("text", text))).where("sentence is not null").join(known, "answer_id", "left")
    cited = F.array_distinct(T.citations(F.col("sentence")))
    rows = rows.withColumn("cited", cited).withColumn("cited_texts", F.transform("cited", lambda n: F.try_element_at("known", n)))
    unknown = F.exists("cited_texts", lambda t: t.isNull())
    reason = F.when(T.is_lead_in(F.col("sentence")) | (F.size("cited") == 0), "skipped").when(F.coalesce(unknown, F.lit(True)), "unknown_citation")
    return rows.select("answer_id", F.struct("line_no", "sentence_no").alias("sentence_id"), "sentence", "cited", "cited_texts", reason.alias("reason"))


def integrity_problems(answers: DataFrame, citations: DataFrame, passages: DataFrame, links: DataFrame) -> DataFrame:
    """answer_id, problem: no citations, links outside the corpus, marks that are no listed citation, figures outside the cited passages.

    answers: answer_id, text; citations: answer_id, number, chunk_id, link; passages: chunk_id, text; links: link.
    """
    none = answers.join(citations, "answer_id", "left_anti").select("answer_id", F.lit("no citations").alias("problem"))
    lost = citations.join(links, "link", "left_anti").select("answer_id", F.concat(F.lit("unknown link "), F.col("link")).alias("problem"))
    marks = answers.select("answer_id", F.explode(F.array_distinct(T.citations(F.col("text")))).alias("number"))
    stray = marks.join(citations, ["answer_id", "number"], "left_anti").select("answer_id", F.concat(F.lit("unknown mark "), F.col("number").cast("string")).alias("problem"))
    have = citations.join(passages.select("chunk_id", T.quantities(F.col("text")).alias("q")), "chunk_id").select("answer_id", F.explode("q").alias("f")).distinct()
    said = answers.select("answer_id", F.explode(T.quantities(F.col("text"))).alias("f"))
    made = said.join(have, ["answer_id", "f"], "left_anti").select("answer_id", F.concat(F.lit("unsupported figure "), F.col("f.value").cast("string"), F.when(F.col("f.is_percent"), "%").otherwise("")).alias("problem"))
    return none.unionByName(lost).unionByName(stray).unionByName(made)


def stated_valuations(answers: DataFrame, terms: list[str]) -> DataFrame:
    """Sentences that name a valuation term and hold a figure."""
    named = F.lit(False)
    for t in terms:
        named = named | F.contains(F.lower("sentence"), F.lit(t.lower()))
    return answer_sentences(answer_lines(answers)).where("sentence is not null").where(named & (F.size(T.quantities(F.col("sentence"))) > 0)).select("answer_id", "sentence")


def exchange_tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\([A-Z]+\s*:\s*[A-Z.]+\))"), F.lit(1))


def lost_tags(before: DataFrame, after: DataFrame) -> DataFrame:
    """Exchange tags (id, tag) that cleaning took away, as a difference of multisets; tables: id, text."""
    rows = lambda t: t.select("id", F.explode(exchange_tags(F.col("text"))).alias("tag"))
    return rows(before).exceptAll(rows(after))


def write_run(results: DataFrame, path: str) -> None:
    """Checks and pass flags of an evaluation run, as JSON."""
    results.write.json(path)
