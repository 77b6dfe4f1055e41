"""Queries over the operators on the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq import config as C
from corpusq.functions import text as T
from corpusq.functions.lineage import checkpoint
from corpusq.operators import coverage as COV
from corpusq.operators import dedup, evaluate, grounding, index, mentions, questions, relevance, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Documents as raw articles: the first line is the title, equal texts share a link, the source is the feed key."""
    docs = table(spark, d, "documents")
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").alias("seq"), F.substring_index(text, "\n", 1).alias("title"), F.concat(F.lit("https://news.example/"), T.article_id(text)).alias("link"), F.col("source").alias("ticker"), text.alias("text"))


_FOLDS = C.QUOTES | C.DASHES | C.SPACES
ARTICLES = "(SELECT doc_id AS seq, split_part(coalesce(text, ''), chr(10), 1) AS title, 'https://news.example/' || substr(sha256(trim(coalesce(text, ''), ' ')), 1, 16) AS link, source AS ticker, coalesce(text, '') AS text FROM documents)"
TOKENS = r"(SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS t FROM documents)"
WORDS = r"len(list_filter(regexp_split_to_array(trim(regexp_replace({}, '\s+', ' ', 'g'), ' '), ' '), lambda x: x <> ''))"


@query(f"""
    WITH tok AS {TOKENS}, p AS (SELECT id, len(t) AS n, unnest(t) AS term FROM tok), tf AS (SELECT id, n, term, count(*) AS tf FROM p GROUP BY ALL),
         q AS (SELECT * FROM (VALUES (1, 'the'), (1, 'thing'), (1, 'ontion'), (2, 'der'), (2, 'einer'), (2, 'und')) v(query_id, term)),
         s AS (SELECT count(*) AS docs, avg(len(t)) AS al FROM tok), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
         w AS (SELECT q.query_id, tf.id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / al))), 6) AS score
               FROM tf JOIN q USING (term) JOIN df USING (term), s GROUP BY 1, 2)
    SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM w QUALIFY rank <= 10""")
def bm25_topk(spark, d):
    q = spark.createDataFrame([(1, "the thing ontion"), (2, "der einer und")], "query_id int, query string")
    return search.bm25(table(spark, d, "documents"), q, "doc_id", "text", 10)


@query(f"WITH p AS (SELECT id, len(t) AS n, unnest(t) AS term FROM {TOKENS}), tf AS (SELECT id, term, count(*) AS tf FROM p GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf GROUP BY 1")
def doc_freq(spark, d):
    return search.postings(table(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query("""
    WITH q AS (SELECT vec_id AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0),
         s AS (SELECT query_id, vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(qv AS DOUBLE[])), 6) AS score FROM embeddings, q WHERE vec_id <> query_id AND label <> 3)
    SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 30""")
def dense_cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    return search.dense_top_k(e, e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), "vec_id", "embedding", C.PREFETCH_K, keep=F.col("label") != 3)


@query("""
    WITH a AS (SELECT lang AS query_id, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 30),
         b AS (SELECT lang AS query_id, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY sha256(coalesce(text, '')), doc_id) AS rank FROM documents QUALIFY rank <= 30),
         s AS (SELECT query_id, id, round(sum(1 / (2 + rank - 1)), 6) AS score FROM (FROM a UNION ALL FROM b) GROUP BY 1, 2)
    SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 8""")
def rrf_fusion(spark, d):
    docs = table(spark, d, "documents")
    a = search.top_k(docs.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").alias("score")), ["query_id"], 30)
    w = docs.select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    from pyspark.sql import Window

    b = w.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("h", "id"))).where("rank <= 30")
    return search.rrf([a, b], C.TOP_K)


FIRST = "SELECT lang AS query_id, doc_id AS id, CAST(n_chars AS BIGINT) AS score, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents WHERE {} QUALIFY rank <= 8"


@query(f"""
    WITH p AS ({FIRST.format("source = 'src1' AND lang <> 'en' OR source = 'src2' AND lang = 'en' AND doc_id % 3 = 0")}), w AS ({FIRST.format("TRUE")}),
         f AS (SELECT query_id FROM p GROUP BY 1 HAVING count(*) >= 8),
         u AS (SELECT query_id, id, score, 0 AS stage, rank FROM p UNION ALL SELECT query_id, id, score, 1, rank FROM w WHERE query_id NOT IN (SELECT query_id FROM f) AND (query_id, id) NOT IN (SELECT query_id, id FROM p))
    SELECT query_id, id, score, stage, CAST(row_number() OVER (PARTITION BY query_id ORDER BY stage, rank) AS INTEGER) AS number FROM u QUALIFY number <= 8""")
def company_first(spark, d):
    docs = table(spark, d, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").alias("score"), "source")
    p = search.top_k(docs.where("source = 'src1' and query_id <> 'en' or source = 'src2' and query_id = 'en' and id % 3 = 0").drop("source"), ["query_id"], C.TOP_K)
    return search.company_first(p, search.top_k(docs.drop("source"), ["query_id"], C.TOP_K), C.TOP_K)


@query(f"""
    WITH a AS {ARTICLES}, r AS (SELECT *, {WORDS.format('text')} AS words, regexp_matches(title, '(?i)^\\s*update:') AS upd FROM a),
         b AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY words DESC, upd DESC, seq) AS r FROM r),
         m AS (SELECT *, max(words * 2 + upd::INT) OVER (PARTITION BY link ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM r),
         k AS (SELECT link, ticker, min(CASE WHEN best IS NULL OR words * 2 + upd::INT > best THEN -seq ELSE seq + 1000000000000 END) AS place FROM m WHERE ticker IS NOT NULL GROUP BY 1, 2),
         s AS (SELECT link, string_agg(ticker, ',' ORDER BY place) AS source_keys FROM k GROUP BY 1), g AS (SELECT link, min(seq) AS seq, count(*) AS copies FROM a GROUP BY 1)
    SELECT g.seq, b.seq AS kept_seq, g.copies, coalesce(s.source_keys, '') AS source_keys FROM g JOIN b USING (link) LEFT JOIN s USING (link) WHERE b.r = 1""")
def exact_dedup_keep_best(spark, d):
    return dedup.merge_by_link(articles(spark, d)).select("seq", "kept_seq", "copies", F.array_join("source_keys", ",").alias("source_keys"))


def _unique(spark, d):
    m = dedup.merge_by_link(articles(spark, d))
    return m.withColumn("is_stub", T.word_count(F.col("text")) < C.MIN_WORDS)


@query(rf"""
    WITH a AS (SELECT min(seq) AS seq, any_value(title) AS title, text FROM {ARTICLES} GROUP BY text),
         t AS (SELECT seq, {WORDS.format('text')} < 80 AS stub, list_distinct(regexp_extract_all(lower(regexp_replace(title, '(?i)^\s*update:\s*', '')), '[\p{{L}}\p{{N}}_]+')) AS tt, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM a),
         s AS (SELECT *, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS sh FROM t),
         p AS (SELECT x.seq AS a, y.seq AS b, CASE WHEN len(x.tt) = 0 AND len(y.tt) = 0 THEN 1.0 ELSE len(list_intersect(x.tt, y.tt)) / (len(x.tt) + len(y.tt) - len(list_intersect(x.tt, y.tt))) END AS ts, x.stub OR y.stub AS stub, x.sh AS xs, y.sh AS ys
               FROM s x JOIN s y ON x.seq < y.seq AND least(len(x.tt), len(y.tt)) >= 0.8 * greatest(len(x.tt), len(y.tt)) AND (len(x.tt) = 0 OR len(list_intersect(x.tt, y.tt)) >= 0.8 * greatest(len(x.tt), len(y.tt)))),
         c AS (SELECT a, b, round(ts, 6) AS title_similarity, CASE WHEN NOT stub THEN round(len(list_intersect(xs, ys)) / (len(xs) + len(ys) - len(list_intersect(xs, ys))), 6) END AS body_similarity FROM p WHERE ts >= 0.8)
    SELECT * FROM c WHERE body_similarity IS NULL OR body_similarity >= 0.6""")
def near_dup_pairs(spark, d):
    return dedup.near_pairs(checkpoint(_unique(spark, d).select("seq", "title", "text", "is_stub")))


@query(rf"""
    WITH RECURSIVE n AS ({SQL["near_dup_pairs"]}),
         q AS (SELECT min(seq) AS seq, {WORDS.format('any_value(text)')} AS words, regexp_matches(arg_max(title, words_), '(?i)^\s*update:') AS upd FROM (SELECT *, 0 AS words_ FROM {ARTICLES}) GROUP BY text),
         p AS (SELECT row_number() OVER (ORDER BY a, b) AS i, a, b, y.words > x.words OR (y.words = x.words AND y.upd AND NOT x.upd) AS second FROM n JOIN q x ON x.seq = a JOIN q y ON y.seq = b),
         r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS gone, CAST([] AS STRUCT(d BIGINT, k BIGINT)[]) AS moves
               UNION ALL
               SELECT p.i, CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN gone ELSE list_append(gone, CASE WHEN second THEN a ELSE b END) END,
                      CASE WHEN list_contains(gone, a) OR list_contains(gone, b) THEN moves ELSE list_append(moves, {{'d': CASE WHEN second THEN a ELSE b END, 'k': CASE WHEN second THEN b ELSE a END}}) END
               FROM r JOIN p ON p.i = r.i + 1),
         m AS (SELECT unnest(moves, recursive := true) FROM (SELECT moves FROM r ORDER BY i DESC LIMIT 1)),
         c AS (SELECT seq, seq AS kept FROM q UNION ALL SELECT c.seq, m.k FROM c JOIN m ON c.kept = m.d)
    SELECT seq, kept AS merged_into FROM c WHERE kept NOT IN (SELECT d FROM m)""")
def greedy_near_dup_survivors(spark, d):
    a = checkpoint(_unique(spark, d).select("seq", "title", "text", "is_stub"))
    return dedup.near_survivors(a, checkpoint).select("seq", "merged_into")


@query()
def dedup_provenance(spark, d):
    a = checkpoint(_unique(spark, d))
    kept = dedup.merge_near(a, dedup.near_survivors(a, checkpoint))
    return kept.select("seq", "link", F.array_join("source_keys", ",").alias("source_keys"), F.array_join("merged_links", ",").alias("merged_links"))


@query(f"SELECT doc_id, replace(translate(text, '{''.join(_FOLDS)}', '{''.join(_FOLDS.values()).replace(chr(39), chr(39) * 2)}'), '…', '...') AS text FROM documents")
def fold_punctuation(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fold_punctuation(F.col("text")).alias("text"))


@query(r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, 'https?://[^\s<>"]*[^\s<>".,;:!?)\]]', ' ', 'g'), 'www\.[^\s<>"]*[^\s<>".,;:!?)\]]', ' ', 'g'), '\s+', ' ', 'g')) AS text,
    CAST(length(html) - length(regexp_replace(html, 'https?://[^\s<>"]*[^\s<>".,;:!?)\]]', '', 'g')) + list_sum(list_transform(regexp_extract_all(regexp_replace(html, 'https?://[^\s<>"]*[^\s<>".,;:!?)\]]', ' ', 'g'), 'www\.[^\s<>"]*[^\s<>".,;:!?)\]]') || [''], lambda x: length(x))) AS INTEGER) AS removed FROM pages""")
def url_removal(spark, d):
    text, removed = T.remove_patterns(F.col("html"), C.URL_PATTERNS)
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"), removed.alias("removed"))


def _tidy_sql(text: str) -> str:
    """The symbol and white-space steps without look-around; what a match took of its neighbour is met by the second pass."""
    fold = f"replace(translate({text}, '{''.join(_FOLDS)}', '{''.join(_FOLDS.values()).replace(chr(39), chr(39) * 2)}'), '…', '...')"
    steps = [(r"([a-z][.!?])([A-Z][a-z])", r"\1 \2")] * 2 + [(p, " ") for p in C.SYMBOL_PATTERNS]
    steps += [(r"\(\s*\)|\[\s*\]", " "), (r"\s+", " "), (r"([.!?])(?:\s+[.,;:])+(\s|$)", r"\1\2"), (r"\s+([.,;:!?)\]])(\D|$)", r"\1\2"), (r"\s+([.,;:!?)\]])(\D|$)", r"\1\2"), (r"([(\[])\s+", r"\1"), (r"^\s+|\s+$", "")]
    for pattern, to in steps:
        fold = f"regexp_replace({fold}, '{pattern}', '{to}', 'g')"
    return fold


@query(f"SELECT doc_id, {_tidy_sql('text')} AS text FROM documents")
def whitespace_tidy(spark, d):
    text, _ = T.remove_patterns(T.space_sentences(T.fold_punctuation(F.col("text"))), C.SYMBOL_PATTERNS)
    return table(spark, d, "documents").select("doc_id", T.tidy_whitespace(text).alias("text"))


@query(f"SELECT doc_id, CASE WHEN regexp_matches(text, 'Released under|Continue reading') THEN 'truncated' WHEN {WORDS.format('text')} < 80 THEN 'too_short' END AS stub FROM documents")
def stub_flag(spark, d):
    from corpusq.operators.stubs import stub_reason

    markers = F.array_compact(F.array(F.when(F.col("text").rlike("Released under|Continue reading"), F.lit("marker"))))
    return table(spark, d, "documents").select("doc_id", stub_reason(F.col("text"), markers).alias("stub"))


@query("SELECT page_id, substr(sha256(trim(url, ' ')), 1, 16) AS article_id, sha256(url || '{\"u\":' || to_json(url) || '}' || 'false') AS hash FROM pages")
def article_ids_and_hashes(spark, d):
    return table(spark, d, "pages").select("page_id", T.article_id(F.col("url")).alias("article_id"), index.content_hash(F.col("url"), F.struct(F.col("url").alias("u")), F.lit(False)).alias("hash"))


@query("""
    WITH a AS (SELECT page_id, substr(sha256(trim(url, ' ')), 1, 16) || ':0' AS name FROM pages),
         h AS (SELECT page_id, sha1(unhex('6f1c3a529d0e4f5b8a7e2c4b1d9e0a31') || encode(name)) AS h FROM a)
    SELECT page_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', h[17:17]) - 1) % 4, 1) || h[18:20] || '-' || h[21:32] AS chunk_id FROM h""")
def chunk_ids(spark, d):
    return table(spark, d, "pages").select("page_id", T.chunk_id(T.article_id(F.col("url")), F.lit(0)).alias("chunk_id"))


@query("""
    WITH v AS (SELECT doc_id AS id, sha256(coalesce(text, '')) AS h FROM documents),
         s AS (SELECT CASE WHEN id % 7 = 0 THEN -id - 1 ELSE id END AS id, CASE WHEN id % 5 = 0 THEN 'old' ELSE h END AS h FROM v), c AS (SELECT id, h FROM v)
    SELECT count(*) FILTER (c.id IS NOT NULL AND s.h IS DISTINCT FROM c.h) AS written, count(*) FILTER (s.h = c.h) AS unchanged, count(*) FILTER (c.id IS NULL) AS stale_removed FROM s FULL JOIN c USING (id)""")
def incremental_sync_report(spark, d):
    v = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))
    stored = v.withColumns({"id": F.when(F.col("id") % 7 == 0, -F.col("id") - 1).otherwise(F.col("id")), "hash": F.when(F.col("id") % 5 == 0, "old").otherwise(F.col("hash"))})
    return index.sync_report(index.sync_plan(stored, v))


def _chunks(spark, d):
    """Documents as chunks: the source is the article's main company, the language one it mentions."""
    return table(spark, d, "documents").select(F.concat_ws("-", "source", (F.col("doc_id") % 400).cast("string")).alias("article_id"), (F.col("n_chars") < 600).alias("is_stub"), F.array("source").alias("primary_tickers"), F.array("lang", F.concat(F.lit("src"), (F.col("doc_id") % 25).cast("string"))).alias("mentioned_tickers"))


CHUNKS = "(SELECT source || '-' || (doc_id % 400) AS article_id, n_chars < 600 AS is_stub, source AS p, [lang, 'src' || (doc_id % 25)] AS m FROM documents)"


@query(f"""
    WITH c AS {CHUNKS}, x AS (SELECT article_id, is_stub, p AS ticker, true AS prim FROM c UNION ALL SELECT article_id, is_stub, unnest(m), false FROM c),
         y AS (SELECT ticker, article_id, bool_or(prim) AS prim, bool_or(prim AND NOT is_stub) AS whole FROM x GROUP BY 1, 2),
         z AS (SELECT ticker, count(*) FILTER (prim) AS primary_articles, count(*) FILTER (whole) AS primary_full_articles, count(*) FILTER (NOT prim) AS mention_articles FROM y GROUP BY 1)
    SELECT *, CASE WHEN primary_full_articles >= 5 THEN 'full' WHEN primary_articles > 0 THEN 'limited' WHEN mention_articles > 0 THEN 'mentions_only' ELSE 'none' END AS level FROM z""")
def coverage_levels(spark, d):
    return COV.coverage(_chunks(spark, d))


@query(f"SELECT p AS ticker, count(DISTINCT article_id) AS primary_articles FROM {CHUNKS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
def most_covered(spark, d):
    return COV.most_covered(COV.coverage(_chunks(spark, d)), 7).select("ticker", "primary_articles")


@query("SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE (d.source IN ('src1', 'src3') OR d.lang IN ('src1', 'src3')) AND d.n_chars >= 600 AND CASE WHEN l.toxic = 1 THEN 'negative' ELSE 'neutral' END = 'neutral' AND l.quality = 1")
def metadata_filter(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("doc_id", F.array("source").alias("primary_tickers"), F.array("lang").alias("mentioned_tickers"), (F.col("n_chars") < 600).alias("is_stub"), F.array(F.when(F.col("quality") == 1, "good").otherwise("bad")).alias("event_types"), F.when(F.col("toxic") == 1, "negative").otherwise("neutral").alias("sentiment"))
    return rows.where(search.predicate(search.SearchFilters(tickers=["src1", "src3"], include_stubs=False, event_types=["good"], sentiment="neutral"))).select("doc_id")


def _mention_rows(spark, d):
    """Words of documents as mentions: words of twelve letters and more are companies, the first line is the title."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("article_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = docs.select("article_id", F.posexplode(F.split("text", "[ \n]+")).alias("start", "w"))
    return words.where(F.length("w") >= 14).select("article_id", F.lower("w").alias("ticker"), F.col("start").cast("int").alias("start"), F.col("w").endswith(",").alias("tagged")), docs


@query(r"""
    WITH w AS (SELECT doc_id AS a, regexp_split_to_array(coalesce(text, ''), '[ \n]+') AS ws FROM documents), n AS (SELECT a, len(ws) AS words FROM w),
         x AS (SELECT a, unnest(ws) AS w, CAST(unnest(range(len(ws))) AS INTEGER) AS p FROM w), b AS (SELECT a, lower(w) AS t, p, w LIKE '%,' AS tag FROM x WHERE length(w) >= 14),
         ti AS (SELECT a, arg_min(t, p) AS subj FROM b WHERE p < 12 GROUP BY 1), tt AS (SELECT DISTINCT a, t FROM b WHERE p < 12),
         g AS (SELECT a, t, count(*) AS m, min(p) AS f, bool_or(tag) AS tagged FROM b GROUP BY 1, 2), h AS (SELECT *, max(m) OVER (PARTITION BY a) AS lead, sum(m) OVER (PARTITION BY a) AS tot FROM g),
         r AS (SELECT h.a, h.t, tt.t IS NOT NULL AS in_title, coalesce(subj = h.t, false) AS title_subject, words <= 60 OR f < 60 AS in_lead, tagged, m, round(CAST(m * 100 AS DOUBLE) / words, 3) AS per, round(CAST(m AS DOUBLE) / tot, 3) AS share, round(CAST(m AS DOUBLE) / lead, 3) AS rel
               FROM h JOIN n USING (a) LEFT JOIN ti USING (a) LEFT JOIN tt ON tt.a = h.a AND tt.t = h.t)
    SELECT a AS article_id, t AS ticker, in_title, title_subject, in_lead, tagged AS exchange_tagged, m AS mentions, per AS mentions_per_100_words, share, rel AS relative_share,
           round(least(CASE WHEN title_subject THEN 0.45::DOUBLE ELSE 0.15::DOUBLE * in_title::INT END + 0.1::DOUBLE * in_lead::INT + 0.05::DOUBLE * tagged::INT + 0.1::DOUBLE * CASE WHEN m >= 2 THEN least(per / 2.0::DOUBLE, 1.0::DOUBLE) ELSE 0.0::DOUBLE END + 0.25::DOUBLE * rel, 1.0::DOUBLE), 3) AS score FROM r""")
def salience_features(spark, d):
    body, docs = _mention_rows(spark, d)
    words = docs.select("article_id", F.size(F.split("text", "[ \n]+")).alias("words")).withColumn("lead_end", F.when(F.col("words") > C.LEAD_WORDS, F.lit(C.LEAD_WORDS)))
    return relevance.salience(body.where("start < 12"), body, words)


@query()
def tone_labels(spark, d):
    pos, neg = relevance.tone_counts(F.array(F.coalesce("text", F.lit(""))))
    return table(spark, d, "conversations").select("conv_id", "turn", pos.alias("positive"), neg.alias("negative")).withColumn("tone", relevance.tone_label(F.col("positive"), F.col("negative")))


def _case(rules, col):
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '(?i){p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in rules)


@query(f"WITH q AS (SELECT conv_id, turn, trim(coalesce(text, ''), ' ') AS q FROM conversations WHERE role = 'user') SELECT conv_id, turn, {_case(C.INTENTS, 'q')} ELSE 'news' END AS intent, regexp_matches(q, '(?i){C.FINANCE}') AS clearly_in_scope FROM q")
def intent_route(spark, d):
    q = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("question"))
    return questions.analyze(q).select("conv_id", "turn", "intent", "clearly_in_scope")


@query()
def quantities_in_documents(spark, d):
    q = T.quantities(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.transform(q, lambda x: F.concat(x["value"].cast("string"), F.when(x["is_percent"], "%").otherwise(""))).alias("quantities"))


@query("""
    WITH v AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN 'judge_supported' ELSE event_type END AS reason FROM events),
         p AS (SELECT user_id, reason, count(*) AS n, min(event_id) AS f FROM v GROUP BY 1, 2),
         g AS (SELECT user_id, CAST(sum(n) AS BIGINT) AS votes, CAST(coalesce(sum(n) FILTER (reason = 'judge_supported'), 0) AS BIGINT) AS yes FROM p GROUP BY 1),
         r AS (SELECT user_id, reason, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM p WHERE reason <> 'judge_supported')
    SELECT user_id, CASE WHEN yes * 2 > votes THEN 'supported' ELSE 'unsupported' END AS verdict, CASE WHEN yes * 2 > votes THEN 'judge_supported' ELSE r.reason END AS reason, round(greatest(yes, votes - yes) / votes, 6) AS agreement
    FROM g LEFT JOIN r USING (user_id) WHERE coalesce(k, 1) = 1""")
def vote_majority(spark, d):
    e = table(spark, d, "events")
    votes = e.select("user_id", F.col("event_id").alias("vote_no"), F.when(F.col("event_type") == "purchase", "judge_supported").otherwise(F.col("event_type")).alias("reason"))
    return evaluate.majority(votes, ["user_id"])


@query("""
    WITH j AS (SELECT user_id AS case_id, count(*) AS judged, count(*) FILTER (event_type = 'purchase') AS supported FROM events GROUP BY 1), s AS (SELECT round(supported / judged, 6) AS score FROM j)
    SELECT round(avg(score), 6) AS mean_score, min(score) AS min_score, avg(score) >= 0.8 AND min(score) >= 0.6 AS passed FROM s""")
def faithfulness_gate(spark, d):
    j = table(spark, d, "events").select(F.col("user_id").alias("case_id"), F.when(F.col("event_type") == "purchase", "supported").otherwise("unsupported").alias("verdict"))
    return evaluate.faithfulness_gate(evaluate.faithfulness(j))


@query("""
    WITH g AS (SELECT o_custkey AS query_id, CAST(o_orderkey AS VARCHAR) AS link, o_orderpriority LIKE '1%' AS reviewed FROM orders),
         r AS (SELECT o_custkey AS query_id, CAST(o_orderkey AS VARCHAR) AS link, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders QUALIFY k <= 8)
    SELECT query_id, count(*) AS gold, count(k) AS found, round(avg((k IS NOT NULL)::INT), 6) AS recall_all, round(avg(CASE WHEN reviewed THEN (k IS NOT NULL)::INT END), 6) AS recall_reviewed,
           array_to_string(list_sort(coalesce(list(link) FILTER (k IS NULL), [])), ',') AS missed FROM g LEFT JOIN r USING (query_id, link) GROUP BY 1""")
def recall_at_k(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").cast("string").alias("link"), F.col("o_orderpriority").startswith("1").alias("reviewed"), F.col("o_totalprice").alias("score"), F.col("o_orderkey").alias("id"))
    ranked = search.top_k(o, ["query_id"], 8)
    return evaluate.recall_at_k(o, ranked, 8).withColumn("missed", F.array_join("missed", ","))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def link_ablation(spark, d):
    return evaluate.ablate(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id")


@query("SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return evaluate.duplicate_ids(table(spark, d, "orders").withColumnRenamed("o_custkey", "id"), "id")


@query(r"""
    WITH x AS (SELECT doc_id, text, regexp_replace(regexp_replace(coalesce(text, ''), '(^|[^\p{L}\p{N}_\p{M}])the($|[^\p{L}\p{N}_\p{M}])', '\1a\2', 'g'), '(^|[^\p{L}\p{N}_\p{M}])the($|[^\p{L}\p{N}_\p{M}])', '\1a\2', 'g') AS changed FROM documents)
    SELECT doc_id, CASE WHEN text IS NULL THEN NULL ELSE changed END AS text, coalesce(changed <> text, false) AS touched FROM x""")
def counterfactual(spark, d):
    docs = table(spark, d, "documents")
    return evaluate.counterfactual(docs, "the", "a", ["text"]).select("doc_id", "text", "touched")


@query(f"SELECT ticker, term FROM (VALUES {', '.join(f'({chr(39)}{t}{chr(39)}, {chr(39)}{x}{chr(39)})' for t, v in C.COMPANIES.items() for x in dict.fromkeys([t, *v[2]]))}) v(ticker, term)")
def registry_terms(spark, d):
    return mentions.terms(spark)


@query()
def company_mentions(spark, d):
    a = articles(spark, d).select(F.col("seq").alias("article_id"), "title", "text")
    return mentions.find_mentions(a).select("article_id", F.size("title_mentions").alias("title_mentions"), F.size("body_mentions").alias("body_mentions"))


@query()
def answer_verification(spark, d):
    turns = table(spark, d, "conversations")
    answers = turns.where("role = 'assistant'").select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), F.concat(F.coalesce("text", F.lit("")), F.lit(" [1]")).alias("text"))
    sources = turns.where("role = 'user'").select(F.concat_ws("-", "conv_id", F.col("turn") + 1).alias("answer_id"), F.lit(1).alias("number"), F.coalesce("text", F.lit("")).alias("text"))
    return grounding.verify(answers, sources).select("answer_id", "text", "cited_numbers", F.size("removed").alias("removed"))


def _news(spark, d):
    """Conversations as news: every user turn a headline with the answer as its body, with companies and boilerplate mixed in by rule."""
    t = table(spark, d, "conversations")
    q = t.where("role = 'user'").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("head"))
    a = t.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.coalesce("text", F.lit("")).alias("body"))
    n = F.col("conv_id") % 5
    lead = F.when(n == 0, "Intel (NASDAQ:INTC) shares rose 7-9% after a deal with Nvidia. ").when(n == 1, "Cerence Inc. (CRNC) beat estimates. Growth was strong, not weak. ").when(n == 2, "Apple will launch a new iPhone for $1.2 billion. ").otherwise("")
    tail = F.when(n == 0, " Read More: Intel Is Up Today. Continue Reading").when(n == 1, " All rights reserved. Contact us at desk@example.com today.").otherwise("")
    title = F.concat(F.when(n == 0, "Intel soars as Nvidia signs: ").when(n == 2, "Should You Buy Apple? ").otherwise(""), F.col("head"))
    seq = (F.col("conv_id") * 1000 + F.col("turn")).alias("seq")
    return q.join(a, ["conv_id", "turn"]).select(seq, title.alias("title"), F.concat(F.lit("https://news.example/"), F.sha1("body")).alias("link"), F.lit("INTC").alias("ticker"), F.concat(lead, F.col("body"), tail).alias("text"))


@query()
def noise_cleaning(spark, d):
    from corpusq.operators import cleaning

    return cleaning.clean(_news(spark, d)).select("seq", "title", "text", F.array_join("signals.truncation_markers", ",").alias("markers"), F.array_join(F.array_sort(F.map_keys("signals.chars_removed_by_rule")), ",").alias("rules"))


@query()
def removal_statistics(spark, d):
    from corpusq.operators import cleaning

    return cleaning.removal_statistics(cleaning.clean(_news(spark, d)))


@query()
def created_numbers(spark, d):
    from corpusq.operators import cleaning

    raw = _news(spark, d)
    both = cleaning.clean(raw).select("seq", F.col("text").alias("clean")).join(raw.select("seq", "text"), "seq")
    return both.select("seq", evaluate.new_numbers(F.col("clean"), F.col("text")).alias("created")).where(F.size("created") > 0)


@query()
def article_chunks(spark, d):
    from corpusq.operators import chunking

    none = F.array().cast("array<string>")
    a = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("article_id"), F.substring_index(F.coalesce("text", F.lit("")), "\n", 1).alias("title"), F.coalesce("text", F.lit("")).alias("text"), none.alias("primary_tickers"), none.alias("mentioned_tickers"), F.lit(False).alias("is_stub"))
    return chunking.chunk(a).select("article_id", "chunk_index", "chunk_id", F.length("text").alias("chars"))


@query()
def offline_build(spark, d):
    from corpusq.plans import offline

    return offline.build(_news(spark, d), checkpoint).select("id", "article_id", "chunk_index", "primary_tickers", "mentioned_tickers", "event_types", "sentiment", "article_type", "is_stub")


def _answers(spark, d):
    from corpusq.plans import offline, online
    from corpusq.sources import store

    index = store.build(checkpoint(offline.build(_news(spark, d), checkpoint)))
    index = store.Index(*map(checkpoint, (index.chunks, index.vectors, index.postings)))
    asked = spark.createDataFrame([(1, "Why did Intel stock jump?"), (2, "What is Apple's current market cap?"), (3, "What happened yesterday?"), (4, "Any news on IBM?"), (5, "Should I buy Nvidia?"), (6, "What do analysts say?")], "question_id int, question string")
    return online.respond(asked, index)


@query()
def online_answers(spark, d):
    return _answers(spark, d).select("question_id", "route", "intent", "tickers", "text", "cited_numbers")


@query()
def answer_events(spark, d):
    from corpusq.plans import online

    return online.events(_answers(spark, d))


@query(r"""
    WITH t AS (SELECT conv_id || '-' || turn AS id, regexp_replace(regexp_replace(coalesce(text, ''), '\[\d+\]', ' ', 'g'), '(?i)\bsources? \d+(?:\s*(?:,|and|&)\s*\d+)*', ' ', 'g') AS x FROM conversations),
         n AS (SELECT id, list_transform(regexp_extract_all(x, '(?:^|[^\p{L}\p{N}_.])((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)', 1), lambda v: replace(v, ',', '')) AS found FROM t)
    SELECT id, array_to_string(list_sort(list_distinct(found)), ' ') AS numbers FROM n""")
def numbers_in_conversations(spark, d):
    from corpusq.functions.text import numbers

    return table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.array_join(numbers(F.coalesce("text", F.lit(""))), " ").alias("numbers"))


@query(r"""
    WITH a AS (SELECT doc_id AS id, regexp_extract_all(replace(coalesce(text, ''), ' the ', ' (NYSE: THE) '), '\([A-Z]+\s*:\s*[A-Z.]+\)') AS w FROM documents),
         b AS (SELECT doc_id AS id, regexp_extract_all(regexp_replace(replace(coalesce(text, ''), ' the ', ' (NYSE: THE) '), '\(NYSE: THE\)', 'the'), '\([A-Z]+\s*:\s*[A-Z.]+\)') AS w FROM documents)
    SELECT id, unnest(w) AS tag FROM a EXCEPT ALL SELECT id, unnest(w) AS tag FROM b""")
def lost_exchange_tags(spark, d):
    text = F.regexp_replace(F.coalesce("text", F.lit("")), " the ", " (NYSE: THE) ")
    before = table(spark, d, "documents").select(F.col("doc_id").alias("id"), text.alias("text"))
    after = before.withColumn("text", F.concat(F.substring_index("text", "(NYSE: THE)", 1), F.when(F.instr("text", "(NYSE: THE)") > 0, F.concat(F.lit("the"), F.expr("substring(text, instr(text, '(NYSE: THE)') + 11)"))).otherwise("")))
    return evaluate.lost_tags(before, after)


@query("SELECT source AS article_id, bool_or(lang = 'en') AS relevant FROM documents GROUP BY 1")
def relevant_articles(spark, d):
    langs = table(spark, d, "documents").groupBy(F.col("source").alias("article_id")).agg(F.collect_set("lang").alias("langs"))
    return langs.select("article_id", relevance.is_relevant(F.filter("langs", lambda x: x == "en")).alias("relevant"))


@query("SELECT page_id AS id, url, html FROM pages")
def payload_round_trip(spark, d):
    from corpusq.sources import store

    rows = table(spark, d, "pages").select(F.col("page_id").alias("id"), "url", "html")
    return store.from_payload(store.to_payload(rows.withColumn("more", F.lit(1))), "id long, url string, html string")


@query(r"""
    WITH l AS (SELECT conv_id, turn, string_split(coalesce(text, ''), chr(10)) AS ls FROM conversations), x AS (SELECT conv_id || '-' || turn AS answer_id, unnest(range(len(ls))) AS i, unnest(ls) AS line, len(ls) AS n FROM l)
    SELECT answer_id, CAST(i AS INTEGER) AS line_no, line FROM x WHERE line <> '' OR i < n - 1""")
def answer_lines(spark, d):
    from corpusq.streaming import lines

    t = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), F.coalesce("text", F.lit("")).alias("text"))
    deltas = t.select("answer_id", F.posexplode(F.split("text", "(?<= )")).alias("seq", "delta"))
    return lines.batch_lines(deltas)


@query("SELECT conv_id, turn, role AS event, coalesce(text, '') AS data FROM conversations WHERE coalesce(text, '') <> ''")
def sse_round_trip(spark, d):
    from corpusq.sources import feeds

    t = table(spark, d, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    frames = t.select("conv_id", "turn", F.explode(feeds.parse_sse(F.concat(F.lit(": hello\n"), feeds.sse(F.col("role"), F.struct("text"))))).alias("f"))
    return frames.select("conv_id", "turn", F.col("f.event").alias("event"), F.get_json_object("f.data", "$.text").alias("data"))


@query("SELECT date_trunc('hour', CAST(ts AS TIMESTAMP)) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_event_counts(spark, d):
    from corpusq.streaming import lines

    return lines.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")


@query()
def relevance_report(spark, d):
    from corpusq.plans import offline
    from corpusq.sources import feeds

    return feeds.relevance_report(offline.enrich(checkpoint(offline.merge(checkpoint(offline.clean_and_flag(_news(spark, d))), checkpoint)), checkpoint))


@query("SELECT count(DISTINCT source || '-' || (doc_id % 400)) AS total_articles FROM documents")
def total_articles(spark, d):
    return COV.total_articles(_chunks(spark, d))


@query("""
    WITH d AS (SELECT user_id % 40 AS a, CAST(event_id AS INTEGER) AS p, event_type AS t FROM events), s AS (SELECT a, CAST(range AS INTEGER) AS s, CAST(range + 300 AS INTEGER) AS e FROM (SELECT DISTINCT a FROM d), (SELECT unnest(range(0, (SELECT max(event_id) + 1 FROM events), 300)) AS range)),
         m AS (SELECT d.a, d.t, d.p, s.s FROM d JOIN s ON d.a = s.a AND d.p >= s.s AND d.p < s.e), y AS (SELECT a, s FROM m GROUP BY 1, 2 HAVING count(DISTINCT t) >= 3),
         z AS (SELECT m.a, m.t, bool_and((m.a, m.s) IN (SELECT a, s FROM y)) AS o FROM m GROUP BY 1, 2)
    SELECT a AS article_id, t AS ticker FROM z WHERE o AND (a, t) NOT IN (SELECT a, t FROM d WHERE p < 50)""")
def enumeration_range_join(spark, d):
    body = table(spark, d, "events").select((F.col("user_id") % 40).alias("article_id"), F.col("event_type").alias("ticker"), F.col("event_id").cast("int").alias("start"))
    last = body.agg(F.greatest(F.max("start"), F.lit(0)).alias("last"))  # one row
    s = body.select("article_id").distinct().crossJoin(F.broadcast(last)).select("article_id", F.explode(F.sequence(F.lit(0), F.col("last"), F.lit(300))).alias("start")).withColumn("end", F.col("start") + 300)
    return relevance.enumeration_only(body, s, body.where("start < 50"), 3)


@query("""
    SELECT doc_id, CASE WHEN tt THEN 'incidental' WHEN s >= CASE k WHEN 'listicle' THEN 0.8 WHEN 'market_wrap' THEN 0.7 ELSE 0.5 END THEN 'primary' WHEN k = 'press_release' THEN 'incidental' ELSE 'mentioned' END AS tier
    FROM (SELECT doc_id, doc_id % 11 = 0 AS tt, (n_chars % 100) / 100.0 AS s, ['listicle', 'market_wrap', 'press_release', 'news'][1 + doc_id % 4] AS k FROM documents)""")
def tiering(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("listicle", "market_wrap", "press_release", "news"))), (1 + F.col("doc_id") % 4).cast("int"))
    return table(spark, d, "documents").select("doc_id", relevance.tier(F.col("doc_id") % 11 == 0, (F.col("n_chars") % 100) / 100, kind).alias("tier"))


@query("""
    WITH r AS (SELECT source AS a, lang AS t, round(avg(n_chars) / 5000, 3) AS s, CASE WHEN count(*) % 2 = 0 THEN 'primary' ELSE 'mentioned' END AS k FROM documents GROUP BY 1, 2)
    SELECT a AS article_id, coalesce(string_agg(t, ',' ORDER BY s DESC, t) FILTER (k = 'primary'), '') AS primary_tickers, coalesce(string_agg(t, ',' ORDER BY s DESC, t) FILTER (k = 'mentioned'), '') AS mentioned_tickers FROM r GROUP BY 1""")
def ordered_tickers(spark, d):
    r = table(spark, d, "documents").groupBy(F.col("source").alias("article_id"), F.col("lang").alias("ticker")).agg(F.round(F.avg("n_chars") / 5000, 3).alias("score"), F.when(F.count(F.lit(1)) % 2 == 0, "primary").otherwise("mentioned").alias("tier"))
    return relevance.ordered_tickers(r).select("article_id", F.array_join("primary_tickers", ",").alias("primary_tickers"), F.array_join("mentioned_tickers", ",").alias("mentioned_tickers"))


@query("SELECT conv_id, turn, CASE WHEN q = '' THEN 'blank' WHEN length(q) > 500 THEN 'too_long' END AS problem, q AS question FROM (SELECT conv_id, turn, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g'), ' ') AS q FROM conversations)")
def request_validation(spark, d):
    q, problem = questions.validate(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", problem.alias("problem"), q.alias("question"))
