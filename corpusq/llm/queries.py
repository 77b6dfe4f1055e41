"""The thin queries over this subpackage's operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm import lang_id, quality
from corpusq.llm.common import read
from corpusq.llm.exact_dedup import exact_dedup
from corpusq.llm.line_dedup import line_dedup
from corpusq.llm.near_dup import near_classes
from corpusq.llm.packing import pack
from corpusq.llm.sp_fst import encode_digest
from corpusq.llm.token_count import token_counts
from corpusq.llm.topk import exact_topk
from corpusq.llm.url_filter import judge_urls

URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.predict(docs, quality.fit(docs, read(spark, sf_dir, "labels")), threshold=0.3)


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(read(spark, sf_dir, "documents"), least=0.8)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digest(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read(spark, sf_dir, "documents"), ratio=0.05, min_pages=5)
    return out.select("doc_id", "host", "n_lines", "n_dropped", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"))


def op10_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return lang_id.predict(docs, lang_id.fit(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_minhash, op3_token_counts, op4_url_filter, op5_exact_topk, op6_packing, op7_sentencepiece, op8_line_dedup, op9_exact_dedup, op10_lang_id)}

ORACLE_SQL = {
    "op5_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             c AS (SELECT DISTINCT vec_id, v FROM v),
             e AS (SELECT vec_id, unnest(v) AS x, unnest(range(len(v))) AS i, len(v) AS n FROM c),
             s AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(sum(a.x * b.x) AS BIGINT) AS score FROM e a JOIN e b ON a.i = b.i AND a.n = b.n AND a.vec_id <> b.vec_id
                   WHERE a.vec_id % 100 = 0 GROUP BY 1, 2),
             r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op8_line_dedup": r"""
        WITH p AS (SELECT row_number() OVER () AS k, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
             t AS (SELECT host, count(*) AS host_pages FROM p GROUP BY 1),
             l AS (SELECT k, host, string_split(text, chr(10)) AS lines FROM p),
             x AS (SELECT k, host, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM l),
             c AS (SELECT host, regexp_replace(line, '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g') AS line, count(DISTINCT k) AS pages FROM x WHERE NOT regexp_full_match(line, '[ \t\r\n\f\v]*') GROUP BY 1, 2),
             d AS (SELECT c.host, c.line FROM c JOIN t USING (host) WHERE c.pages >= 5 AND c.pages / t.host_pages > 0.05),
             y AS (SELECT x.k, count(*) AS n_lines, count(d.line) AS n_dropped, coalesce(string_agg(CASE WHEN d.line IS NULL THEN x.line END, chr(10) ORDER BY x.i), '') AS text
                   FROM x LEFT JOIN d ON x.host = d.host AND regexp_replace(x.line, '^[ \t\r\n\f\v]+|[ \t\r\n\f\v]+$', '', 'g') = d.line GROUP BY 1)
        SELECT p.doc_id, p.host, CAST(y.n_lines AS INTEGER) AS n_lines, CAST(y.n_dropped AS INTEGER) AS n_dropped, CAST(length(y.text) AS BIGINT) AS n_chars_kept, sha256(y.text) AS text_sha256
        FROM p JOIN y USING (k)""",
    "op9_exact_dedup": """
        SELECT DISTINCT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
}
