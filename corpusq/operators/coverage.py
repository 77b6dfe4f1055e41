"""Coverage of companies by articles; counts articles, not chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq import config as C


def coverage(chunks: DataFrame, tickers: DataFrame | None = None, full: int = C.FULL_COVERAGE) -> DataFrame:
    """ticker, primary_articles, primary_full_articles, mention_articles, level.

    Chunks: article_id, is_stub, primary_tickers, mentioned_tickers. Mentions leave out primary articles; stubs
    do not count toward FULL. ``tickers`` (one column ticker) adds companies without articles as NONE.
    """
    one = lambda c, flag: chunks.select("article_id", "is_stub", F.explode(c).alias("ticker"), F.lit(flag).alias("primary"))
    per = one("primary_tickers", True).unionByName(one("mentioned_tickers", False)).groupBy("ticker", "article_id").agg(F.max("primary").alias("primary"), F.max(F.col("primary") & ~F.col("is_stub")).alias("whole"))
    out = per.groupBy("ticker").agg(F.count_if("primary").alias("primary_articles"), F.count_if("whole").alias("primary_full_articles"), F.count_if(~F.col("primary")).alias("mention_articles"))
    if tickers is not None:
        out = tickers.join(out, "ticker", "left").na.fill(0, ["primary_articles", "primary_full_articles", "mention_articles"])
    level = F.when(F.col("primary_full_articles") >= full, "full").when(F.col("primary_articles") > 0, "limited").when(F.col("mention_articles") > 0, "mentions_only").otherwise("none")
    return out.withColumn("level", level)


def most_covered(report: DataFrame, limit: int, among: list[str] | None = None) -> DataFrame:
    """The companies with most primary articles (more than none); ties in the order of ``among``, else by name."""
    rows = report.where("primary_articles > 0")
    if among is None:
        return rows.orderBy(F.desc("primary_articles"), "ticker").limit(limit)
    place = F.array_position(F.array(*map(F.lit, among)), F.col("ticker"))
    return rows.where(place > 0).orderBy(F.desc("primary_articles"), place).limit(limit)


def total_articles(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("article_id").alias("total_articles"))


def notice(report: DataFrame) -> DataFrame:
    """The caveat for a company (column company), null where coverage is full."""
    say = lambda n, one, many: F.concat(n.cast("string"), F.when(n == 1, f" article{one}").otherwise(f" articles{many}"))
    p, m, c = F.col("primary_articles"), F.col("mention_articles"), F.col("company")
    text = (
        F.when(F.col("level") == "limited", F.concat(F.lit("Coverage of "), c, F.lit(" in this news set is limited: "), say(p, " focuses", " focus"), F.lit(" on it and "), say(m, " mentions", " mention"), F.lit(" it in passing.")))
        .when(F.col("level") == "mentions_only", F.concat(F.lit("There's no dedicated news about "), c, F.lit(" in this dataset; it's only mentioned in passing in "), say(m, "", ""), F.lit(".")))
        .when(F.col("level") == "none", F.concat(F.lit("None of the articles in this dataset mention "), c, F.lit(".")))
    )
    return report.withColumn("notice", text)


def guidance(report: DataFrame) -> DataFrame:
    """What the model is told about a company (column company) of which little is known; null where coverage is full."""
    c = F.col("company")
    text = F.concat(F.lit("Coverage of "), c, F.lit(" is thin. Summarise only what the sources actually say about "), c, F.lit("; ignore their content about other companies. Do not pad the answer with loosely related material, and it is fine for the answer to be short."))
    return report.withColumn("guidance", F.when(F.col("level") != "full", text))
