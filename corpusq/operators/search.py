"""Retrieval: BM25, dense cosine, rank fusion, the metadata predicate and the company-first strategy."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusq import config as C
from corpusq.functions.text import let, words


@dataclass(frozen=True)
class SearchFilters:
    """Typed metadata filter; unset fields do not restrict."""

    tickers: list[str] = field(default_factory=list)
    primary_only: bool = False
    include_stubs: bool = True
    event_types: list[str] = field(default_factory=list)
    sentiment: str | None = None
    article_type: str | None = None


def predicate(f: SearchFilters) -> Column | None:
    """The AND of the fields that are set, or None; a plain column, so it sinks below ranking and joins."""
    parts: list[Column] = []
    if f.tickers:
        wanted = F.array(*map(F.lit, f.tickers))
        hit = F.arrays_overlap("primary_tickers", wanted)
        parts.append(hit if f.primary_only else hit | F.arrays_overlap("mentioned_tickers", wanted))
    if not f.include_stubs:
        parts.append(~F.col("is_stub"))
    if f.event_types:
        parts.append(F.arrays_overlap("event_types", F.array(*map(F.lit, f.event_types))))
    if f.sentiment is not None:
        parts.append(F.col("sentiment") == f.sentiment)
    if f.article_type is not None:
        parts.append(F.col("article_type") == f.article_type)
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, term, tf, doc_len: the inverted index."""
    tokens = docs.select(F.col(id_col).alias("id"), words(F.coalesce(text_col, F.lit(""))).alias("t"))
    return tokens.select("id", F.size("t").alias("doc_len"), F.explode("t").alias("term")).groupBy("id", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def _bm25_weight(k1: float, b: float) -> Column:
    """Of a posting with tf, doc_len, df and the totals n and avg_len."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len")))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term: the distinct words of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(words(F.col("query")))).alias("term"))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text_col: str, k: int, k1: float = C.BM25_K1, b: float = C.BM25_B, keep: Column | None = None, max_terms: int = 10_000) -> DataFrame:
    """query_id, id, score, rank (from 1): the k best documents of each query (query_id, query), straight from texts.

    Statistics are the whole table's; ``keep`` filters candidates below the ranking. One scan tokenises each text once:
    it keeps the length and the counts of the queries' words. They stand in the plan as a literal if there are ``max_terms``
    at most; more of them meet the words in a semi-join. Ties go to the smaller id; documents without a
    query term are no candidates.
    """
    terms = query_terms(queries)
    asked = terms.select("term").distinct()
    first = [r["term"] for r in asked.limit(max_terms + 1).collect()]
    tokens = docs.select(F.col(id_col).alias("id"), (keep if keep is not None else F.lit(True)).alias("keep"), words(F.coalesce(text_col, F.lit(""))).alias("t"))
    if len(first) <= max_terms:
        wanted = F.array(*map(F.lit, sorted(first))) if first else F.array().cast("array<string>")
        hits = lambda t: F.transform(F.array_intersect(t, wanted), lambda w: F.struct(w.alias("term"), F.size(F.filter(t, lambda x: x == w)).cast("long").alias("tf")))
        slim = tokens.select("id", "keep", let(F.col("t"), lambda t: F.struct(F.size(t).alias("doc_len"), hits(t).alias("hits"))).alias("x")).select("id", "keep", "x.doc_len", "x.hits")
        index = slim.select("id", "keep", "doc_len", F.explode("hits").alias("h")).select("id", "keep", "doc_len", "h.term", "h.tf")
        lengths = slim.select("doc_len")
    else:
        index = tokens.select("id", "keep", F.size("t").alias("doc_len"), F.explode("t").alias("term")).join(asked, "term", "left_semi").groupBy("id", "keep", "doc_len", "term").agg(F.count(F.lit(1)).alias("tf"))
        lengths = tokens.select(F.size("t").alias("doc_len"))
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avg_len"))
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = index.where("keep").join(df, "term").crossJoin(F.broadcast(totals))  # one row of totals
    sums = scored.withColumn("w", _bm25_weight(k1, b)).join(terms, "term").groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score"))
    return top_k(sums, ["query_id"], k)


def bm25_postings(postings_: DataFrame, lengths: DataFrame, queries: DataFrame, k1: float = C.BM25_K1, b: float = C.BM25_B) -> DataFrame:
    """query_id, id, score of all documents with a query term, from stored postings (term, id, tf) and lengths (id, doc_len)."""
    terms = query_terms(queries)
    totals = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("doc_len").alias("avg_len"))
    hits = postings_.join(terms.select("term").distinct(), "term", "left_semi")
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = hits.join(df, "term").join(lengths, "id").crossJoin(F.broadcast(totals))  # one row of totals
    return scored.withColumn("w", _bm25_weight(k1, b)).join(terms, "term").groupBy("query_id", "id").agg(F.round(F.sum("w"), 6).alias("score"))


def top_k(scored: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k best rows per key; the limit acts on the map side too (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def as_batch(queries: DataFrame, max_queries: int) -> DataFrame:
    """The queries, broadcast if they are ``max_queries`` at most; beyond that Spark pairs partitions with partitions."""
    return queries if queries.limit(max_queries + 1).count() > max_queries else F.broadcast(queries)


#: Components of a block of the table and of a block of queries; a task holds a pair of blocks and the scores of SCORED queries.
POOL_BLOCK, QUERY_BLOCK, SCORED = 1 << 22, 1 << 19, 64
#: Types of ids that are compared as long integers.
INTEGERS = ("tinyint", "smallint", "int", "bigint")
#: Cosines that differ by more than a step of the sixth digit differ when rounded; the rest is for errors of the product.
SLACK = 1e-6 + 1e-9


def _block_scorer(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of two blocks of vectors (id, own, v; query_id, own, q) the pairs that may be among a query's k best, with their cosine.

    A matrix product is the filter. What stands within rounding of a query's k-th best gets the cosine summed from left
    to right, as the plain columns do. Carries its code, as executors need not have this package.
    """
    scored, slack = SCORED, SLACK

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        def matrix(c: pa.ChunkedArray) -> np.ndarray:
            c = c.combine_chunks()
            return np.asarray(c.flatten(), dtype=np.float64).reshape(len(c), -1)

        def norm(x: np.ndarray) -> np.ndarray:
            s = np.zeros(len(x))
            for j in range(x.shape[1]):
                s += x[:, j] * x[:, j]
            return np.sqrt(s)

        def result(qi: np.ndarray, pi: np.ndarray, s: np.ndarray) -> pa.Table:
            return pa.table({"query_id": right["query_id"].combine_chunks().take(pa.array(qi)), "id": left["id"].combine_chunks().take(pa.array(pi)), "cosine": pa.array(s, pa.float64())})

        if not len(left) or not len(right):
            return result(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        p, q = matrix(left["v"]), matrix(right["q"])
        pn, qn = norm(p), norm(q)
        unit, asked = (p / pn[:, None]).T.copy(), q / qn[:, None]
        codes = pa.chunked_array([*left["own"].chunks, *right["own"].chunks]).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        code, mine = codes[: len(p)], codes[len(p) :]
        order = np.argsort(code, kind="stable")
        first, last = (np.searchsorted(code[order], mine, side) for side in ("left", "right"))
        groups = max(1, min(len(p), 8 * k))
        edges = np.linspace(0, len(p), groups + 1).astype(np.int64)[:-1]
        found: list[tuple] = []
        for at in range(0, len(q), scored):
            s = asked[at : at + scored] @ unit
            for i in range(len(s)):
                if last[at + i] > first[at + i]:
                    s[i, order[first[at + i] : last[at + i]]] = -np.inf
            floor = np.full(len(s), -np.inf)
            if groups > k:  # k groups with a better or equal best hold k better or equal rows
                floor = np.partition(np.maximum.reduceat(s, edges, axis=1), groups - k, axis=1)[:, groups - k]
            a, b = np.nonzero((s >= floor[:, None] - slack) & (s > -np.inf))
            if len(a) > k * len(s):  # the k-th best itself is a higher floor
                c = s[a, b]
                rank = np.lexsort((-c, a))
                start = np.searchsorted(a, np.arange(len(s)))
                full = np.diff(np.append(start, len(a))) >= k
                floor[full] = c[rank][start[full] + k - 1]
                keep = c >= floor[a] - slack
                a, b = a[keep], b[keep]
            found.append((a + at, b))
        qi, pi = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        dot = np.zeros(len(qi))
        for j in range(p.shape[1]):
            dot += p[pi, j] * q[qi, j]
        return result(qi, pi, dot / (pn[pi] * qn[qi]))

    return run


def dense_top_k(vectors: DataFrame, queries: DataFrame, id_col: str, vec_col: str, k: int, keep: Column | None = None, max_queries: int = 50) -> DataFrame:
    """query_id, id, score (cosine, 6 digits), rank. ``queries``: query_id, query_vec; at most ``max_queries`` rows are broadcast.

    More queries than that meet the vectors block by block: every block of queries meets every block of the table, in tasks
    of bounded size, where a matrix product leaves the pairs that can be among the k best. Of vectors that repeat exactly, the
    rows of the k + 1 smallest ids take part, as no other can be among the k best. Vectors that are null, of
    another length than most, or not finite and of a usual size, meet all others as plain columns. Filters apply below the ranking.
    """
    pool = vectors.where(keep) if keep is not None else vectors
    as_double = lambda c: F.transform(c, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    pool = pool.select(F.col(id_col).alias("id"), as_double(F.col(vec_col)).alias("v")).withColumn("n", norm(F.col("v")))
    asked = queries.select("query_id", as_double(F.col("query_vec")).alias("q")).withColumn("qn", norm(F.col("q")))

    def plain(pool: DataFrame, asked: DataFrame) -> DataFrame:
        pairs = pool.crossJoin(asked).where("id <> query_id")
        return pairs.select("query_id", "id", F.round(dot(F.col("v"), F.col("q")) / (F.col("n") * F.col("qn")), 6).alias("score"))

    if asked.limit(max_queries + 1).count() <= max_queries:
        return top_k(plain(pool, F.broadcast(asked)), ["query_id"], k)
    kind, query_kind = (df.schema[c].dataType.simpleString() for df, c in ((pool, "id"), (asked, "query_id")))
    if kind != query_kind and not {kind, query_kind} <= {*INTEGERS}:
        return top_k(plain(pool, asked), ["query_id"], k)
    own = lambda c: F.col(c).cast("long" if kind in INTEGERS else kind).alias("own")
    size = pool.agg(F.count(F.lit(1)).alias("rows"), F.mode(F.when(F.size("v") > 0, F.size("v")), True).alias("dim")).first()
    usual = lambda v, n, id_: F.coalesce((F.size(v) == F.lit(size["dim"])) & (F.col(n) > 1e-100) & (F.col(n) < 1e100) & F.col(id_).isNotNull(), F.lit(False))
    clean, odd = pool.where(usual("v", "n", "id")), pool.where(~usual("v", "n", "id"))
    good, rest = asked.where(usual("q", "qn", "query_id")), asked.where(~usual("q", "qn", "query_id"))
    first = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    single = clean.select("id", "v").withColumn("r", first).where(F.col("r") <= k + 1).drop("r")
    blocks, turns = (max(1, -(-n * (size["dim"] or 0) // b)) for n, b in ((size["rows"], POOL_BLOCK), (asked.count(), QUERY_BLOCK)))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    of = lambda c, n, name: F.pmod(F.xxhash64(c), F.lit(n)).cast("int").alias(name)
    left = single.select(of("id", blocks, "block"), every(turns, "turn"), "id", own("id"), "v")
    right = good.select(every(blocks, "block"), of("query_id", turns, "turn"), "query_id", own("query_id"), "q")
    score = _block_scorer(k)

    def met(a, b):  # the two blocks of a pair
        return score(a, b)

    near = left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn")).applyInArrow(met, f"query_id {query_kind}, id {kind}, cosine double")
    scored = near.select("query_id", "id", F.round("cosine", 6).alias("score"))
    for p, q, few in ((odd, asked, odd), (clean, rest, rest)):
        if not few.isEmpty():  # a product of partitions reads one side again for each of the other, even if it is empty
            scored = scored.unionByName(plain(p, q))
    return top_k(scored, ["query_id"], k)


def rrf(ranked: list[DataFrame], k: int, constant: int = C.RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, id, rank from 1)."""
    parts = [r.select("query_id", "id", (1.0 / (constant + F.col("rank") - 1)).alias("part")) for r in ranked]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return top_k(every.groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score")), ["query_id"], k)


#: Words added to a question by intent.
EXPANSION = {"price_target": "price target analyst rating", "analyst_view": "analyst rating price target upgrade downgrade", "causal": "shares jumped surged rose report", "advice": "analyst rating outlook", "prediction": "analyst outlook expects"}


def expand(question: Column, intent: Column) -> Column:
    more = F.create_map(*[F.lit(x) for kv in EXPANSION.items() for x in kv])[intent]
    return F.concat_ws(" ", question, more)


def company_first(primary: DataFrame, wider: DataFrame, k: int) -> DataFrame:
    """Ranked primary hits, then unseen hits of the wider search in their order, k in all; never re-sorted by score.

    Both: query_id, id, score, rank. Queries that the primary search fills do not touch the wider one.
    """
    full = primary.groupBy("query_id").agg(F.count(F.lit(1)).alias("have")).where(F.col("have") >= k).select("query_id")
    more = wider.join(full, "query_id", "left_anti").join(primary.select("query_id", "id"), ["query_id", "id"], "left_anti")
    both = primary.select("query_id", "id", "score", F.lit(0).alias("stage"), "rank").unionByName(more.select("query_id", "id", "score", F.lit(1).alias("stage"), "rank"))
    w = Window.partitionBy("query_id").orderBy("stage", "rank")
    return both.withColumn("number", F.row_number().over(w)).where(F.col("number") <= k).select("query_id", "id", "score", "stage", "number")


def render_sources(sources: DataFrame) -> DataFrame:
    """A block per numbered source (number, text, is_stub, passing): ``[n]``, its warnings, then the text."""
    notes = F.concat_ws("; ", F.when(F.col("is_stub"), "PARTIAL"), F.when(F.col("passing"), "mentions the company only in passing"))
    label = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("]"), F.when(notes != "", F.concat(F.lit(" ("), notes, F.lit(")"))).otherwise(F.lit("")))
    return sources.withColumn("block", F.concat_ws("\n", label, F.col("text")))
