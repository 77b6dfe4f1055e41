"""Relevance: article type, salience, tiers, focus sentences, events and tone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq import config as C
from corpusq.functions.text import any_match, first_match, let, stem, stem_word

#: Positions of a stretch by which places and spans of an article meet.
STRETCH = 256


def article_type(title: Column, text: Column) -> tuple[Column, Column]:
    """(label, cue): the first rule whose pattern is in the title, or in the lead where the rule says so; else news."""
    lead = F.substring(text, 1, C.LEAD_CHARS)
    label, cue = F.lit("news"), F.lit(None).cast("string")
    for name, patterns, in_lead in reversed(C.ARTICLE_TYPES):
        hit = F.coalesce(first_match(title, patterns), *([first_match(lead, patterns)] if in_lead else []))
        label, cue = F.when(hit.isNotNull(), name).otherwise(label), F.when(hit.isNotNull(), hit).otherwise(cue)
    return label, cue


def salience(title: DataFrame, body: DataFrame, words: DataFrame) -> DataFrame:
    """Features and score per article and ticker.

    title, body: article_id, ticker, start, tagged (one row per mention); words: article_id, words, lead_end
    (start of the 61st word, null if there are fewer). One aggregation per side; the leader's count is a window
    over an article's few tickers.
    """
    first = title.groupBy("article_id").agg(F.min_by("ticker", "start").alias("subject"))
    t = title.select("article_id", "ticker").distinct().withColumn("in_title", F.lit(True))
    b = body.groupBy("article_id", "ticker").agg(F.count(F.lit(1)).alias("mentions"), F.min("start").alias("first_start"), F.max("tagged").alias("exchange_tagged"))
    every = t.join(b, ["article_id", "ticker"], "full").join(first, "article_id", "left").join(words, "article_id", "left")
    n, w = F.coalesce("mentions", F.lit(0)), Window.partitionBy("article_id")
    every = every.withColumn("mentions", n).withColumn("leader", F.max("mentions").over(w)).withColumn("total", F.sum("mentions").over(w))
    out = every.select(
        "article_id",
        "ticker",
        F.coalesce("in_title", F.lit(False)).alias("in_title"),
        F.coalesce(F.col("subject") == F.col("ticker"), F.lit(False)).alias("title_subject"),
        F.coalesce(F.col("first_start").isNotNull() & (F.col("lead_end").isNull() | (F.col("first_start") < F.col("lead_end"))), F.lit(False)).alias("in_lead"),
        F.coalesce("exchange_tagged", F.lit(False)).alias("exchange_tagged"),
        "mentions",
        F.round(F.col("mentions") * 100 / F.greatest(F.coalesce("words", F.lit(1)), F.lit(1)), 3).alias("mentions_per_100_words"),
        F.when(F.col("total") > 0, F.round(F.col("mentions") / F.col("total"), 3)).otherwise(0.0).alias("share"),
        F.when(F.col("leader") > 0, F.round(F.col("mentions") / F.col("leader"), 3)).otherwise(0.0).alias("relative_share"),
    )
    return out.withColumn("score", score())


def score() -> Column:
    """The weighted sum of the features, at most 1, to three digits."""
    flag = lambda c: F.col(c).cast("double")
    head = F.when(F.col("title_subject"), C.TITLE_SUBJECT_WEIGHT).otherwise(C.TITLE_WEIGHT * flag("in_title"))
    often = F.when(F.col("mentions") >= C.FREQUENCY_MIN, F.least(F.col("mentions_per_100_words") / C.FREQUENCY_CAP, F.lit(1.0))).otherwise(0.0)
    return F.round(F.least(head + C.LEAD_WEIGHT * flag("in_lead") + C.TAGGED_WEIGHT * flag("exchange_tagged") + C.FREQUENCY_WEIGHT * often + C.SHARE_WEIGHT * F.col("relative_share"), F.lit(1.0)), 3)


def within(points: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of points (article_id, p, ...) with the s and e of the spans (article_id, s, e) that hold them: s <= p < e.

    Each span is listed under every stretch of ``STRETCH`` positions that it touches and meets only the points of these,
    so the work follows the length of the texts, not positions times spans. Spans may overlap.
    """
    at = lambda c: F.floor(c / STRETCH).cast("long")
    listed = spans.select("article_id", "s", "e").where("s < e").withColumn("stretch", F.explode(F.sequence(at(F.col("s")), at(F.col("e") - 1))))
    return points.withColumn("stretch", at(F.col("p"))).join(listed, ["article_id", "stretch"]).where("s <= p and p < e").drop("stretch")


def enumeration_only(body: DataFrame, sentences: DataFrame, title: DataFrame, least: int = C.ENUMERATION_MIN) -> DataFrame:
    """article_id, ticker of companies named only in sentences that name ``least`` companies or more, and not in the title."""
    s = sentences.select("article_id", F.col("start").alias("s"), F.col("end").alias("e"))
    inside = within(body.select("article_id", "ticker", F.col("start").alias("p")), s)
    many = inside.groupBy("article_id", "s").agg((F.countDistinct("ticker") >= least).alias("many")).where("many").select("article_id", "s")
    listed = inside.join(many, ["article_id", "s"], "left_semi").select("article_id", "ticker", F.col("p").alias("start")).distinct().withColumn("listed", F.lit(True))
    marked = body.join(listed, ["article_id", "ticker", "start"], "left")
    only = marked.groupBy("article_id", "ticker").agg(F.min(F.coalesce("listed", F.lit(False))).alias("only")).where("only").select("article_id", "ticker")
    return only.join(title.select("article_id", "ticker").distinct(), ["article_id", "ticker"], "left_anti")


def tier(incidental: Column, score_: Column, type_: Column) -> Column:
    """primary, mentioned or incidental."""
    limit = F.coalesce(F.create_map(*[F.lit(x) for kv in C.PRIMARY_BY_TYPE.items() for x in kv])[type_], F.lit(C.PRIMARY_THRESHOLD))
    return F.when(incidental, "incidental").when(score_ >= limit, "primary").when(type_.isin(C.INCIDENTAL_TYPES), "incidental").otherwise("mentioned")


def ordered_tickers(scored: DataFrame) -> DataFrame:
    """article_id with one array per tier: most salient first, ties by name."""
    pick = lambda t: F.transform(F.array_sort(F.collect_list(F.when(F.col("tier") == t, F.struct((-F.col("score")).alias("s"), "ticker")))), lambda x: x["ticker"])
    return scored.groupBy("article_id").agg(*[pick(t).alias(f"{t}_tickers") for t in ("primary", "mentioned", "incidental")])


def focus_sentences(sentences: DataFrame, body: DataFrame, primary: DataFrame) -> DataFrame:
    """The sentences (article_id, number, start, end, ...) naming a primary company; all of an article without one."""
    hits = body.join(primary.select("article_id", "ticker").distinct(), ["article_id", "ticker"], "left_semi").select("article_id", F.col("start").alias("p"))
    held = within(hits, sentences.select("article_id", F.col("start").alias("s"), F.col("end").alias("e")))
    named = sentences.join(held.select("article_id", F.col("s").alias("start"), F.col("e").alias("end")).distinct(), ["article_id", "start", "end"], "left_semi").select(*sentences.columns)
    return named.unionByName(sentences.join(primary.select("article_id").distinct(), "article_id", "left_anti"))


def events(texts: Column) -> Column:
    """Event names, in their fixed order, with a pattern in any of the texts (title and focus sentences)."""
    said = lambda patterns: F.exists(texts, lambda t: any_match(t, patterns))
    return F.array_compact(F.array(*[F.when(said(p), F.lit(e)) for e, p in C.EVENTS.items()]))


def tone(sentences: Column) -> Column:
    """struct<positive, negative>: tone words; a negator among the three words before flips one.

    Only words that begin like a tone word's stem are stemmed, which few do.
    """
    stems = [sorted({stem_word(w) for w in ws}) for ws in (C.POSITIVE, C.NEGATIVE)]
    sets = [F.array(*map(F.lit, s)) for s in stems]
    least = min(3, *map(len, stems[0] + stems[1]))  # stemming keeps so many letters
    begins = sorted({s[:least] for s in stems[0] + stems[1]})
    negators = F.array(*map(F.lit, C.NEGATORS))
    per = F.transform(sentences, lambda s: F.transform(F.regexp_extract_all(s, F.lit(r"([A-Za-z']+)"), F.lit(1)), F.lower))

    def polarity(words: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            p = let(stem(w), lambda s: F.array_contains(sets[0], s).cast("int") - F.array_contains(sets[1], s).cast("int"))
            before = F.slice(words, F.greatest(i - C.NEGATION_WINDOW, F.lit(0)) + 1, F.least(i, F.lit(C.NEGATION_WINDOW)))
            signed = let(p, lambda x: F.when((x != 0) & F.arrays_overlap(before, negators), -x).otherwise(x))
            return F.when(F.substring(w, 1, least).isin(*begins), signed).otherwise(0)

        return F.transform(words, one)

    flat = F.flatten(F.transform(per, polarity))
    return let(flat, lambda f: F.struct(F.size(F.filter(f, lambda x: x > 0)).alias("positive"), F.size(F.filter(f, lambda x: x < 0)).alias("negative")))


def tone_counts(sentences: Column) -> tuple[Column, Column]:
    """(positive, negative) of :func:`tone`."""
    both = tone(sentences)
    return both["positive"], both["negative"]


def tone_label(positive: Column, negative: Column) -> Column:
    hits = positive + negative
    p = (positive - negative) / hits
    return F.when(hits < C.TONE_MIN_HITS, "neutral").when(p >= C.TONE_THRESHOLD, "positive").when(p <= -C.TONE_THRESHOLD, "negative").when(F.least(positive, negative) >= C.TONE_MIXED_MIN, "mixed").otherwise("neutral")


def is_relevant(primary_tickers: Column) -> Column:
    """Whether an article is about some company."""
    return F.size(primary_tickers) > 0
