"""The online plan: a table of questions to events and verified answers over a stored index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq import config as C
from corpusq.functions.lineage import checkpoint
from corpusq.operators import coverage as COV
from corpusq.operators import grounding, questions, search
from corpusq.operators.mentions import display_name
from corpusq.plans import providers
from corpusq.sources import feeds, store

#: Templates of the default prompt; a deployment passes its own.
SYSTEM = "Answer from the numbered sources alone. Cite a source as [n] after each sentence."
BY_INTENT = {"news": "Summarise the news about the question."}


@dataclass(frozen=True)
class Ports:
    """What can be replaced: encoder of questions, writer of drafts, guard of scope, and a wrapper around the retriever.

    ``draft``: requests (question_id, prompt, sources) to question_id, draft, error, tokens. ``guard``: question column to
    boolean, null where it failed. ``wrap``: retrieved passages to passages, as evaluation needs.
    """

    encode: store.Encode = providers.encode_hashed
    draft: Callable[[DataFrame], DataFrame] = providers.extractive_answer
    guard: Callable[[Column], Column] | None = None
    wrap: Callable[[DataFrame], DataFrame] = lambda passages: passages
    system: str = SYSTEM
    by_intent: tuple[tuple[str, str], ...] = tuple(BY_INTENT.items())


def encoded(plans: DataFrame, encode: store.Encode) -> DataFrame:
    """The plans with query (expanded by intent), qv and encode_error."""
    q = plans.withColumn("query", search.expand(F.col("question"), F.col("intent")))
    found = encode(q.select(F.col("question_id").alias("id"), F.col("query").alias("text")))
    return q.join(found.select(F.col("id").alias("question_id"), F.col("vector").alias("qv"), F.col("error").alias("encode_error")), "question_id")


def retrieve(plans: DataFrame, index: store.Index, k: int = C.TOP_K, prefetch: int = C.PREFETCH_K, max_queries: int = 1000) -> DataFrame:
    """question_id, number, id, score, stage: hybrid search, the named companies first. Plans: question_id, query, qv, tickers.

    Questions about companies see chunks about them, then chunks that mention them; others see all. The filter acts
    below each ranking: a chunk is scored for a stage only if its companies match. Either pool is scored once
    for both stages. A batch of at most ``max_queries`` questions is broadcast to the vectors.
    """
    asked = plans.select(F.col("question_id").alias("query_id"), "query", "qv", "tickers")
    about = index.chunks.select("id", "primary_tickers", "mentioned_tickers")
    main = F.arrays_overlap("primary_tickers", "tickers")
    stages = F.when(F.size("tickers") == 0, F.array(F.lit(0))).when(main, F.array(F.lit(0), F.lit(1))).when(F.arrays_overlap("mentioned_tickers", "tickers"), F.array(F.lit(1)))
    sparse = store.sparse_scores(index, asked).join(search.as_batch(asked.select("query_id", "tickers"), max_queries), "query_id").join(about, "id")
    batch = search.as_batch(asked.select("query_id", "qv", "tickers"), max_queries)
    everything = index.vectors.join(about, "id").crossJoin(batch)
    dot = F.aggregate(F.zip_with("vector", "qv", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    lists = []
    for pool in (sparse, everything.withColumn("score", F.lit(0.0))):
        rows = pool.withColumn("stage", stages).where(F.col("stage").isNotNull())
        if pool is not sparse:  # only pairs that some stage admits are scored
            rows = rows.withColumn("score", F.round(dot, 6))
        each = rows.select("query_id", F.explode("stage").alias("stage"), "id", "score")
        lists.append(search.top_k(each, ["query_id", "stage"], prefetch))
    parts = lists[0].unionByName(lists[1]).select("query_id", "stage", "id", (1.0 / (C.RRF_K + F.col("rank") - 1)).alias("part"))
    fused = checkpoint(search.top_k(parts.groupBy("query_id", "stage", "id").agg(F.round(F.sum("part"), 6).alias("score")), ["query_id", "stage"], k))
    first, wider = fused.where("stage = 0").drop("stage"), fused.where("stage = 1").drop("stage")
    return search.company_first(first, wider, k).select(F.col("query_id").alias("question_id"), "number", "id", "score", "stage")


def notices(plans: DataFrame, reports: DataFrame) -> DataFrame:
    """question_id, covered (notices on companies, in order), guidance (for the model)."""
    said = COV.guidance(COV.notice(reports)).select("ticker", "notice", "guidance")
    each = plans.select("question_id", F.posexplode("tickers").alias("p", "ticker")).join(said, "ticker", "left")
    line = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("p", c)))), lambda x: x[c]), "\n\n" if c == "notice" else "\n")
    return each.groupBy("question_id").agg(line("notice").alias("covered"), line("guidance").alias("guidance"))


def respond(asked: DataFrame, index: store.Index, ports: Ports = Ports()) -> DataFrame:  # noqa: B008 - frozen
    """One row per question: question_id, question, intent, tickers, coverage, route, sources, lines, error, text, cited_numbers, citations, notices, removed, chunk_ids, tokens.

    Routes, in order: out_of_scope, timing, live_data, not_covered, retrieval_error, nothing_found, model_error, answered.
    """
    plans = questions.analyze(asked)
    named = plans.select(F.explode("tickers").alias("ticker")).distinct()
    covered = checkpoint(COV.coverage(index.chunks))
    reports = named.join(covered, "ticker", "left").na.fill(0, ["primary_articles", "primary_full_articles", "mention_articles"]).na.fill("none", ["level"]).withColumn("company", display_name(F.col("ticker")))
    guard = ports.guard(F.col("question")) if ports.guard else None
    routed = questions.route(plans, reports, guard).join(notices(plans, reports), "question_id", "left")
    struct = F.struct("ticker", "level", "primary_articles", "primary_full_articles", "mention_articles")
    stated = plans.select("question_id", F.posexplode("tickers").alias("p", "ticker")).join(reports, "ticker").groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", struct.alias("r")))), lambda x: x["r"]).alias("coverage"))
    routed = checkpoint(routed.join(stated, "question_id", "left"))
    queries = checkpoint(encoded(routed.where("route = 'retrieve'"), ports.encode))
    hits = retrieve(queries.where("encode_error is null"), index).drop("stage")
    payload = index.chunks.select("id", "title", "link", "is_stub", "primary_tickers", "contextualized_text")
    passages = ports.wrap(hits.join(payload, "id").join(routed.select("question_id", "tickers"), "question_id").withColumnRenamed("contextualized_text", "text"))
    passages = passages.withColumn("number", F.row_number().over(Window.partitionBy("question_id").orderBy("number")))
    passing = (F.size("tickers") > 0) & ~F.arrays_overlap("primary_tickers", "tickers")
    sources = checkpoint(search.render_sources(passages.withColumn("passing", passing)).select("question_id", "number", "id", "title", "link", "is_stub", "text", "block"))
    shown = F.struct("number", "title", "link", F.col("is_stub").alias("is_partial"), F.col("id").alias("chunk_id"))
    per = sources.groupBy("question_id").agg(F.array_sort(F.collect_list(shown)).alias("sources"), F.array_sort(F.collect_list(F.struct("number", "block"))).alias("blocks"), F.array_sort(F.collect_list(F.struct("number", "text"))).alias("texts"))
    text = questions.prompt(F.col("intent"), F.col("question"), F.array_join(F.transform("blocks", lambda x: x["block"]), "\n\n"), F.coalesce("guidance", F.lit("")), ports.system, dict(ports.by_intent))
    requests = per.join(routed.select("question_id", "question", "intent", "guidance"), "question_id").select("question_id", text.alias("prompt"), F.col("texts").alias("sources"))
    drafts = checkpoint(ports.draft(requests))
    checked = grounding.verify(drafts.where("error is null").select(F.col("question_id").alias("answer_id"), F.col("draft").alias("text")), sources.select(F.col("question_id").alias("answer_id"), "number", "text"))
    rows = routed.join(queries.select("question_id", "encode_error"), "question_id", "left").join(per.select("question_id", "sources"), "question_id", "left")
    rows = rows.join(drafts.select("question_id", F.col("error").alias("model_error"), "tokens"), "question_id", "left").join(checked.withColumnRenamed("answer_id", "question_id").withColumnRenamed("text", "body"), "question_id", "left")
    how = F.when(F.col("route") != "retrieve", F.col("route")).when(F.col("encode_error").isNotNull(), "retrieval_error").when(F.col("sources").isNull(), "nothing_found").when(F.col("model_error").isNotNull(), "model_error").otherwise("answered")
    rows = rows.withColumn("route", how)
    top = COV.most_covered(covered, 7, list(C.COMPANIES)).withColumn("company", display_name(F.col("ticker")))
    order = Window.orderBy(F.desc("primary_articles"), F.array_position(F.array(*map(F.lit, C.COMPANIES)), F.col("ticker")))
    timing = questions.timing_answer(top.withColumn("place", F.row_number().over(order)), COV.total_articles(index.chunks))  # seven rows
    rows = rows.crossJoin(F.broadcast(timing.withColumnRenamed("text", "timing_text")))  # one row
    used = F.filter("sources", lambda s: F.array_contains(F.col("cited_numbers"), s["number"]))
    company = F.when(F.size("tickers") > 0, display_name(F.element_at("tickers", 1)))
    live = F.when(F.col("intent") == "live_data", questions.live_data_notice(company, F.col("live_metric")))
    before = grounding.joined([live, F.when(F.col("intent") == "timing", C.NO_DATES), F.col("covered")])
    after = grounding.closing_notices(F.exists(used, lambda s: s["is_partial"]), F.col("intent"))
    rows = rows.withColumn("before", before).withColumn("after", F.when(F.col("route") == "answered", after))
    text = (
        F.when(F.col("route") == "out_of_scope", C.OUT_OF_SCOPE)
        .when(F.col("route") == "timing", F.col("timing_text"))
        .when(F.col("route") == "live_data", F.col("before"))
        .when(F.col("route") == "not_covered", F.col("covered"))
        .when(F.col("route").isin("retrieval_error", "model_error"), grounding.joined([F.col("before"), F.lit(C.ANSWER_UNAVAILABLE)]))
        .when(F.col("route") == "nothing_found", grounding.joined([F.col("before"), F.lit(C.NO_GROUNDED_ANSWER)]))
        .otherwise(grounding.joined([F.col("before"), F.when(F.col("body") != "", F.col("body")).otherwise(C.NO_GROUNDED_ANSWER), F.col("after")]))
    )
    said = F.when(F.col("route") == "out_of_scope", F.array(F.lit(C.OUT_OF_SCOPE))).when(F.col("route") == "timing", F.array(F.lit(C.NO_DATES))).otherwise(F.filter(F.array("before", "after"), lambda n: n != ""))
    none = F.array().cast("array<int>")
    return rows.select(
        "question_id", "question", "intent", "tickers", F.coalesce("coverage", F.array()).alias("coverage"), "route", "sources", "lines",
        F.coalesce("encode_error", "model_error").alias("error"), text.alias("text"), F.coalesce("cited_numbers", none).alias("cited_numbers"),
        F.when(F.col("route") == "answered", used).alias("citations"), said.alias("notices"), F.coalesce(F.size("removed"), F.lit(0)).alias("removed"),
        F.transform("sources", lambda s: s["chunk_id"]).alias("chunk_ids"), "tokens",
    )


def answer(asked: DataFrame, index: store.Index, ports: Ports = Ports()) -> DataFrame:  # noqa: B008 - frozen
    """question_id, route, intent, tickers, text, cited_numbers. Asked: question_id, question."""
    return respond(asked, index, ports).select("question_id", "route", "intent", "tickers", "text", "cited_numbers")


def events(answers: DataFrame) -> DataFrame:
    """question_id, seq, event, frame of what :func:`respond` returns: meta, sources, delta for each line, error, final."""
    body = lambda *c: F.to_json(F.struct(*c), {"ignoreNullFields": "false"})
    row = lambda name, data: F.struct(F.lit(name).alias("event"), data.alias("data"))
    meta = F.array(row("meta", body("intent", "tickers", "coverage")))
    sources = F.when(F.col("sources").isNotNull(), F.array(row("sources", body("sources"))))
    last = lambda i: i == F.size("lines") - 1
    deltas = F.when(F.col("route") == "answered", F.transform("lines", lambda x, i: row("delta", F.to_json(F.struct(F.concat(x["text"], F.when(last(i), "").otherwise("\n")).alias("text"))))))
    error = F.when(F.col("error").isNotNull(), F.array(row("error", body(F.col("error").alias("message")))))
    final = F.array(row("final", body(F.col("text").alias("answer"), F.coalesce("citations", F.array()).alias("citations"), "notices", F.col("removed").alias("removed_sentences"))))
    none = F.array().cast("array<struct<event:string,data:string>>")
    every = F.concat(meta, F.coalesce(sources, none), F.coalesce(deltas, none), F.coalesce(error, none), final)
    rows = answers.select("question_id", F.posexplode(every).alias("seq", "e"))
    frame = F.concat(F.lit("event: "), F.col("e.event"), F.lit("\ndata: "), F.col("e.data"), F.lit("\n\n"))
    return rows.select("question_id", "seq", F.col("e.event").alias("event"), F.col("e.data").alias("data"), frame.alias("frame"))


def run_log(answers: DataFrame, latency_ms: int | None = None) -> DataFrame:
    """One JSON line per question: what was asked, found, used and removed; ``latency_ms`` is the batch's."""
    return feeds.run_log(answers, latency_ms)
