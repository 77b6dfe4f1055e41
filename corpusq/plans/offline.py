"""The offline plan: raw articles to cleaned, merged, enriched, chunked and indexed rows."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.functions import sentences as S
from corpusq.functions import text as T
from corpusq.functions.lineage import checkpoint
from corpusq.operators import chunking, cleaning, dedup, index, mentions, relevance, stubs
from corpusq.sources import feeds, store


def clean_and_flag(raw: DataFrame) -> DataFrame:
    """Cleaned articles with article_id and is_stub (flagged before merging, which needs it)."""
    c = cleaning.clean(raw)
    return c.withColumn("is_stub", stubs.stub_reason(F.col("text"), F.col("signals.truncation_markers")).isNotNull()).withColumn("article_id", T.article_id(F.col("link")))


def merge(cleaned: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One article per story: by link, then near-duplicates; keys and links of dropped copies join their survivor's."""
    flags = cleaned.groupBy("link").agg(F.max_by("is_stub", F.struct(T.word_count(F.col("text")), dedup.is_update(F.col("title")), -F.col("seq"))).alias("is_stub"))
    unique = checkpoint(dedup.merge_by_link(cleaned).join(flags, "link"))
    survivors = dedup.near_survivors(unique, checkpoint)
    return dedup.merge_near(unique, survivors).select("seq", T.article_id(F.col("link")).alias("article_id"), "link", "title", "text", "is_stub", "source_keys", "merged_links")


def enrich(articles: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Articles with tiers, event_types, sentiment, article_type and cue."""
    found = checkpoint(mentions.find_mentions(articles))
    rows = lambda c: found.select("article_id", F.explode(c).alias("m")).select("article_id", "m.ticker", "m.start", "m.tagged")
    title, body = rows("title_mentions"), rows("body_mentions")
    words = articles.select("article_id", T.word_count(F.col("text")).alias("words"), (F.length(F.regexp_extract("text", r"(?U)^(\s*(?:\S+\s+){60})\S", 1))).alias("lead")).select("article_id", "words", F.when(F.col("words") > 60, F.col("lead")).alias("lead_end"))
    spans = checkpoint(articles.select("article_id", F.posexplode(S.sentence_spans(F.col("text"))).alias("number", "s")).select("article_id", "number", "s.start", "s.end"))
    label, cue = relevance.article_type(F.col("title"), F.col("text"))
    typed = articles.withColumn("article_type", label).withColumn("article_type_cue", cue)
    listed = relevance.enumeration_only(body, spans, title).withColumn("listed", F.lit(True))
    scored = relevance.salience(title, body, words).join(listed, ["article_id", "ticker"], "left").join(typed.select("article_id", "article_type"), "article_id")
    scored = checkpoint(scored.withColumn("tier", relevance.tier(F.coalesce("listed", F.lit(False)), F.col("score"), F.col("article_type"))))
    focus = relevance.focus_sentences(spans, body, scored.where("tier = 'primary'"))
    focus = focus.groupBy("article_id").agg(F.array_sort(F.collect_list(F.struct("number", "start", "end"))).alias("focus"))
    names = relevance.ordered_tickers(scored)
    salience = scored.groupBy("article_id").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "score"))).alias("salience"))
    none = F.array().cast("array<string>")
    out = typed.join(names, "article_id", "left").join(salience, "article_id", "left").join(focus, "article_id", "left")
    for t in ("primary", "mentioned", "incidental"):
        out = out.withColumn(f"{t}_tickers", F.coalesce(f"{t}_tickers", none))
    out = out.withColumn("focus", F.coalesce(F.transform("focus", lambda x: F.substring(F.col("text"), x["start"] + 1, x["end"] - x["start"])), none))
    sentiment = T.let(relevance.tone(F.col("focus")), lambda t: relevance.tone_label(t["positive"], t["negative"]))
    return out.withColumn("event_types", relevance.events(F.concat(F.array("title"), "focus"))).withColumn("sentiment", sentiment).drop("focus")


def index_rows(enriched: DataFrame) -> DataFrame:
    """Chunks ready to index: id, hash and the metadata that filters use."""
    chunks = chunking.chunk(enriched)
    meta = ["title", "link", "is_stub", "primary_tickers", "mentioned_tickers", "event_types", "sentiment", "article_type"]
    rows = chunks.join(enriched.select("article_id", *meta, "article_type_cue"), "article_id")
    return rows.withColumn("id", F.col("chunk_id")).withColumn("hash", index.content_hash(F.col("contextualized_text"), F.struct("primary_tickers", "mentioned_tickers", "event_types", "sentiment", "article_type", "article_type_cue"), F.col("is_stub")))


def build(raw: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The whole chain. Raw: seq, title, link, ticker, text."""
    return index_rows(checkpoint(enrich(checkpoint(merge(checkpoint(clean_and_flag(raw)), checkpoint)), checkpoint)))


def main(argv: list[str]) -> None:
    """offline FEED INDEX [--lines]: index a feed (a JSON object, or JSON lines), print the report of the sync."""
    spark = SparkSession.builder.getOrCreate()
    read = feeds.read_feed_lines if "--lines" in argv else feeds.read_feed
    feed, path = (a for a in argv if not a.startswith("--"))
    print(store.sync(spark, path, checkpoint(build(read(spark, feed), checkpoint))).first().asDict())


if __name__ == "__main__":
    main(sys.argv[1:])
