"""Operators of the analytics engine: small cases with known results, and plans."""

import json
import os
import subprocess
import sys
import uuid

import pytest
from pyspark.sql import functions as F

from corpusq import config as C
from corpusq.functions import sentences as S
from corpusq.functions import text as T
from corpusq.functions.lineage import checkpoint
from corpusq.operators import chunking, cleaning, coverage, dedup, evaluate, grounding, index, mentions, questions, relevance, search, stubs
from corpusq.plans import online, providers
from corpusq.queries import QUERIES
from corpusq.sources import feeds, rules, store
from corpusq.streaming import lines


def one(spark, expr, **values):
    kinds = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(expr.alias("x")).first().x


@pytest.mark.parametrize(("text", "want"), [("It said “so” — fine…", 'It said "so" - fine...'), ("−5%", "-5%"), ("a b", "a b")])
def test_fold(spark, text, want):
    assert one(spark, T.fold_punctuation(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("compare?The impact", "compare? The impact"), ("5.3 BRK.B Amazon.com", "5.3 BRK.B Amazon.com")])
def test_sentence_spacing(spark, text, want):
    assert one(spark, T.space_sentences(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [(" a  b ", "a b"), ("5 .3", "5 .3"), ("stock. . Next", "stock. Next"), ("( ) x", "x"), ("( a ) , b", "(a), b"), ("now... and", "now... and")])
def test_whitespace(spark, text, want):
    got = one(spark, T.tidy_whitespace(F.col("t")), t=text)
    assert got == want and one(spark, T.tidy_whitespace(F.col("t")), t=got) == got


def test_url_and_symbol_removal(spark):
    text, n = T.remove_patterns(F.col("t"), C.URL_PATTERNS)
    assert one(spark, text, t="see https://a.b/c, and x.com") == "see  , and x.com"
    assert one(spark, n, t="see https://a.b/c, www.x.org.") == len("https://a.b/c") + len("www.x.org")
    assert one(spark, T.remove_patterns(F.col("t"), C.SYMBOL_PATTERNS)[0], t="a★★b™ €5") == "a b  €5"


@pytest.mark.parametrize(("title", "text", "want"), [("Intel Up", "intel  up Shares rose", "Shares rose"), ("Intel", "Intelligent", "Intelligent"), ("", "x", "x"), ("A b", "A b", "")])
def test_repeated_title(spark, title, text, want):
    assert one(spark, T.drop_repeated_title(F.col("t"), F.col("h")), t=text, h=title) == want


def test_ids(spark):
    ns = uuid.UUID(C.POINT_NAMESPACE)
    assert one(spark, T.chunk_id(F.col("a"), F.lit(3)), a="abc") == str(uuid.uuid5(ns, "abc:3"))
    assert len(one(spark, T.article_id(F.col("a")), a=" link ")) == 16


@pytest.mark.parametrize("word", ["surges", "surged", "surging", "dies", "rallies", "rally", "loss", "losses", "beat's", "free"])
def test_stem_is_the_same_at_planning_and_run_time(spark, word):
    assert one(spark, T.stem(F.col("w")), w=word) == T.stem_word(word)


def test_quantities(spark):
    q = lambda t: {(float(x.value), x.is_percent) for x in one(spark, T.quantities(F.col("t")), t=t)}
    assert q("$1.2B") == q("1.2 billion") == q("1,200 million") == {(1.2e9, False)}
    assert q("7-9%") == {(7, True), (9, True)} and q("1 to 2 billion") == {(1e9, False), (2e9, False)}
    assert q("15 per cent") == q("15%") != q("15")
    assert q("Q4 H100 [3] sources 1 and 4") == set() and q("Model 3 M") == {(3, False)}
    assert q("5-7-9%") == {(5, False), (7, True), (9, True)}
    assert one(spark, T.numbers(F.col("t")), t="$1,024.05 and 7") == ["1024.05", "7"]


def test_citations(spark):
    assert one(spark, T.citations(F.col("t")), t="x [1] y [12]") == [1, 12]
    assert one(spark, T.strip_citations(F.col("t")), t="x [1] y [12].") == "x y."
    assert one(spark, T.drop_unknown_citations(F.col("t"), F.array(F.lit(1))), t="x [1][9]") == "x [1]"
    assert one(spark, T.is_lead_in(F.col("t")), t="Here it is: ") and not one(spark, T.is_lead_in(F.col("t")), t="Up 5:")


def test_sentences_lose_nothing():
    text = 'Mr. Smith of the U.S. firm paid $5.3 billion. "Good!" he said. No. 5 won.\nNext line'
    assert S.split(text) == ["Mr. Smith of the U.S. firm paid $5.3 billion.", '"Good!"', "he said.", "No. 5 won.", "Next line"]
    assert "".join("".join(text[a:b].split()) for a, b in S.spans(text)) == "".join(text.split())


def test_stubs(spark):
    df = spark.createDataFrame([("w " * 79, []), ("w " * 80, []), ("w", ["m"])], "t string, m array<string>")
    assert [r.x for r in df.select(stubs.stub_reason(F.col("t"), F.col("m")).alias("x")).collect()] == ["too_short", None, "truncated"]


# --- Cleaning -----------------------------------------------------------------------------------------------------
def noise(text, title=""):
    return cleaning.remove_noise(text, title, cleaning.compiled())


def test_noise_rules():
    text, marks, removed, kept = noise("Shares fell. Continue Reading View Comments")
    assert "Continue" not in text and "View" not in text and marks == ["continue_reading"] and set(removed) == {"continue_reading", "view_comments"}
    assert "newsletter" not in noise("It rose. Sign up for our newsletter today. It fell.")[0] and "It fell." in noise("It rose. Sign up for our newsletter today. It fell.")[0]
    tail = " Should you invest $1,000 in Intel right now? Before you buy stock in Intel, read this."
    assert noise("Intel rose." + tail)[0].strip() == "Intel rose."
    kept_text, _, _, kept = noise("Intel rose." + tail + " Nvidia said on Monday that sales grew by a third.")
    assert kept == ["motley_fool_footer"] and "Nvidia said" in kept_text
    assert noise("Up 5% (read more: Is It Over?). Then it fell.")[0] == "Up 5%  . Then it fell."
    assert "555" not in noise("Call 212-555-0100 now.")[0] and noise("Sales were 1,212-555 units")[0] == "Sales were 1,212-555 units"
    assert "Rank" in noise("A Zacks Rank #3 (Hold) stock")[0]
    assert "Rank" not in cleaning.remove_noise("A Zacks Rank #3 (Hold) stock", "", cleaning.compiled(False))[0]


def test_promo_blocks_end_where_prose_begins():
    text = "Trending: Five Hot Chips To Buy Now The company said it would grow."
    assert text[cleaning.Prose(text).promo_end(len("Trending:")) :] == "The company said it would grow."
    assert cleaning.Prose("x:").promo_end(2) == 2 and cleaning.without("abcdef", cleaning.islands([(2, 4), (1, 3)])) == "a ef"
    assert cleaning.islands([(5, 5), (0, 2), (2, 3), (8, 9)]).tolist() == [[0, 3], [5, 5], [8, 9]] and cleaning.without("ab", cleaning.islands([])) == "ab"
    words = "x: " + "Word " * 100
    assert words[2 : cleaning.Prose(words).promo_end(2)].split() == ["Word"] * 60


def test_encoding_repair():
    for good in ("it’s", "café", "“x”", "naïve €5", "Ünder"):
        assert cleaning.repair_encoding(good) == good
        bad = good.encode().decode("cp1252", "replace")
        if "�" not in bad:
            assert cleaning.repair_encoding(bad) == good


def test_clean_driver(spark):
    raw = spark.createDataFrame([(1, "Intel  “Up”", " https://n/1 ", "INTC", 'Intel "Up" Shares rose 5%.Then they fell ® Continue Reading', "more")], "seq long, title string, link string, ticker string, text string, signal string")
    r = cleaning.clean(raw).first()
    assert (r.title, r.link, r.text, r.signal) == ('Intel "Up"', "https://n/1", "Shares rose 5%.Then they fell", "more")
    assert r.signals.truncation_markers == ["continue_reading"] and r.signals.chars_removed_by_rule == {"continue_reading": 16}
    again = cleaning.clean(raw.withColumn("text", F.lit(r.text))).first()
    assert again.text == r.text
    with pytest.raises(ValueError):
        cleaning.clean(raw, steps=("nope",))


def test_python_functions_get_small_batches(spark):
    """However large a partition, a worker of the cleaning and chunking functions holds few rows at once."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    try:
        for use in (cleaning.clean, chunking.chunk):
            spark.conf.set(rows, "10000")
            none = F.array().cast("array<string>")
            use(spark.range(1).select(F.lit("a").alias("article_id"), F.lit("t").alias("title"), F.lit("x").alias("text"), none.alias("primary_tickers"), none.alias("mentioned_tickers"), F.lit(False).alias("is_stub")))
            assert int(spark.conf.get(rows)) <= 500
    finally:
        spark.conf.set(rows, before)


# --- Deduplication --------------------------------------------------------------------------------------------------
def articles(spark, rows):
    return spark.createDataFrame(rows, "seq long, title string, link string, ticker string, text string, is_stub boolean")


def test_merge_by_link(spark):
    a = articles(spark, [(0, "T", "l", "A", "one two", False), (1, "T", "l", "B", "one two three", False), (2, "Update: T", "m", "C", "x y", False), (3, "T", "m", "A", "x y", False)])
    got = {r.link: r for r in dedup.merge_by_link(a).collect()}
    assert got["l"].seq == 0 and got["l"].kept_seq == 1 and got["l"].source_keys == ["B", "A"] and got["m"].kept_seq == 2 and got["m"].copies == 2


def test_near_duplicates(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(0, "Intel shares jump on deal", "a", "A", body, False), (1, "Update: Intel shares jump on deal", "b", "B", body, False), (2, "Other title here entirely", "c", "A", body, False), (3, "Intel shares jump on deal", "d", "A", "quite other words", True), (4, "Intel shares jump on deal", "e", "A", " ".join(f"v{i}" for i in range(60)), False), (5, "!!", "f", "A", "p", True), (6, "??", "g", "A", "q", True)]
    a = articles(spark, rows)
    pairs = {(r.a, r.b) for r in dedup.near_pairs(a).collect()}
    assert pairs == {(0, 1), (0, 3), (1, 3), (3, 4), (5, 6)}
    into = {r.seq: r.merged_into for r in dedup.greedy_survivors(a, dedup.near_pairs(a), checkpoint).collect()}
    assert into == {0: 1, 1: 1, 2: 2, 3: 1, 4: 4, 5: 5, 6: 5}


def test_merging_follows_chains_and_keeps_order(spark):
    """Three versions of a story, each longer than the one before: the last one stays alone, with the others' keys and links."""
    words = [f"w{i}" for i in range(100)]
    rows = [(i, "Intel shares jump", f"l{i}", f"K{i}", " ".join(words[: 90 + 3 * i]), False) for i in range(3)] + [(3, "Other title entirely here", "x", "A", "unlike", True)]
    a = dedup.merge_by_link(articles(spark, rows)).withColumn("is_stub", F.col("link") == "x")
    kept = dedup.merge_near(a, dedup.greedy_survivors(a, dedup.near_pairs(a), checkpoint)).collect()
    assert {(r.seq, tuple(r.source_keys), tuple(r.merged_links)) for r in kept} == {(2, ("K2", "K1", "K0"), ("l1", "l0")), (3, ("A",), ())}


def test_source_keys_keep_the_order_of_merging(spark):
    import random

    r = random.Random(2)
    rows = [(i, r.choice(["T", "Update: T"]), f"l{r.randrange(4)}", r.choice("ABCDE"), " ".join(["w"] * r.randrange(1, 5)), False) for i in range(60)]
    want = {}
    for _, title, link, key, text, _ in rows:
        size, keys = (len(text.split()), title.startswith("Update")), [key]
        old, old_keys = want.get(link, ((-1, False), []))
        wins = size[0] > old[0] or (size[0] == old[0] and size[1] and not old[1])
        want[link] = (size, list(dict.fromkeys(keys + old_keys))) if wins else (old, list(dict.fromkeys(old_keys + keys)))
    got = {x.link: x.source_keys for x in dedup.merge_by_link(articles(spark, rows)).collect()}
    assert got == {k: v for k, (_, v) in want.items()}


def test_untitled_articles_pair_as_brute_force_says(spark):
    import random

    r = random.Random(7)
    base = [f"v{i}" for i in range(30)]
    texts = [" ".join(w if r.random() > 0.04 else "edit" for w in base) for _ in range(14)] + ["p", "q"]
    rows = [(i, "!!", f"l{i}", "A", t, i >= 12) for i, t in enumerate(texts)]
    sets = [{tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for t in texts]
    want = {(i, j) for j in range(16) for i in range(j) if j >= 12 or i >= 12 or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6}
    assert {(x.a, x.b) for x in dedup.near_pairs(articles(spark, rows)).collect()} == want


def test_near_dup_plan_has_no_cartesian_product(spark):
    a = articles(spark, [(0, "x y", "a", "A", "t", False)])
    near = dedup.title_candidates(a)
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_survivors_equal_replaying_every_pair(spark):
    """Titles that many share, some alike, with stubs among the articles: the replay by titles is that of all pairs in order."""
    import random

    r = random.Random(3)
    heads = ["Intel shares jump on a big deal today", "Update: Intel shares jump on a big deal today", "Intel shares jump on a big deal", "!!", "Apple sells phones"]
    base = {h: [f"{h[-1]}{i}" for i in range(40)] for h in heads}
    rows = []
    for i in r.sample(range(1000), 90):
        h = r.choice(heads)
        stub = r.random() < 0.2
        text = " ".join(f"s{r.randrange(99)}" for _ in range(r.randrange(9))) if stub else " ".join(w if r.random() > 0.03 else "x" for w in base[h][: r.randrange(30, 41)])
        rows.append((i, h, f"l{i}", "A", text, stub))
    a = articles(spark, rows)
    words, upd = ({x[0]: f(x) for x in rows} for f in (lambda x: len(x[4].split()), lambda x: x[1].startswith("Update")))
    live = {x[0]: [x[0]] for x in rows}
    for p in sorted((p.a, p.b) for p in dedup.near_pairs(a).collect()):
        if p[0] in live and p[1] in live:
            keep, drop = p[::-1] if (words[p[1]], upd[p[1]]) > (words[p[0]], upd[p[0]]) else p
            live[keep] += live.pop(drop)
    want = {(s, k, i) for k, own in live.items() for i, s in enumerate(own)}
    assert {tuple(x) for x in dedup.near_survivors(a, checkpoint).collect()} == want
    assert {tuple(x) for x in dedup.greedy_survivors(a, dedup.near_pairs(a), checkpoint).collect()} == want


def test_articles_of_one_title_are_not_all_compared(spark):
    """400 unlike articles with one title: no candidates; a stub among them pairs with each."""
    body = lambda i: " ".join(f"w{i}x{j}" for j in range(30))
    a = articles(spark, [(i, "The same title", f"l{i}", "A", body(i // 2 if i < 4 else i), i == 399) for i in range(400)])
    assert dedup.title_candidates(a).count() == 399 + 2


# --- Entities and relevance -----------------------------------------------------------------------------------------
def test_places_meet_spans_by_stretch(spark):
    """Long, short, empty and overlapping spans against all pairs, and no join on the article alone."""
    import random

    r = random.Random(5)
    points = [(r.randrange(3), r.randrange(3000)) for _ in range(200)]
    spans = list({(r.randrange(3), s := r.randrange(3000), s + r.choice([0, 1, 40, 256, 900])) for _ in range(120)})
    p, s = spark.createDataFrame(points, "article_id int, p int"), spark.createDataFrame(spans, "article_id int, s int, e int")
    got = relevance.within(p, s)
    assert sorted((x.article_id, x.p, x.s, x.e) for x in got.collect()) == sorted((a, q, s, e) for a, q in points for b, s, e in spans if a == b and s <= q < e)
    assert "stretch" in next(x for x in got._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x)


def tickers(found):
    return [m.ticker for m in found]


def found(spark, title, text):
    r = mentions.find_mentions(spark.createDataFrame([(1, title, text)], "article_id int, title string, text string")).first()
    return r.title_mentions, r.body_mentions, r.learned_names


def test_mentions(spark):
    text = "Shares of CyberArk Software Inc. (CYBR) rose. CyberArk beat NVIDIA; the iPhone and (NLP) natural language processing (NLP)."
    _, body, learned = found(spark, "", text)
    assert [(m.ticker, text[m.start : m.end], m.form, m.tagged) for m in body] == [("CYBR", "CyberArk Software", "name", False), ("CYBR", "(CYBR)", "ticker", True), ("CYBR", "CyberArk", "name", False), ("NVDA", "NVIDIA", "name", False), ("AAPL", "iPhone", "product", False)]
    assert learned == {"CyberArk Software": "CYBR", "CyberArk": "CYBR"}
    head, body, _ = found(spark, "Intel and amd", "Intel (NASDAQ:INTC) and Walmart (NYSE: WMT)")
    assert tickers(head) == ["INTC", "AMD"] and [(m.ticker, m.tagged) for m in body if m.tagged] == [("INTC", True), ("WMT", True)]
    _, body, learned = found(spark, "", "Deep Ultra Violet (DUV) and Zed Corp ZZZ shares, then Yam YYY fell. Our Big Model (OBM) works.")
    assert tickers(body) == ["ZZZ"] and learned == {}  # "Zed" is too short to learn, YYY neither recurs nor follows a legal form
    assert found(spark, "", "")[1] == []


def test_patterns_meet_only_texts_that_hold_their_words(spark):
    texts = ["nothing here", "İntel and ıntel, Teſla, \u212aindle, bacKslash", "AAPLE $AAPL aapl", "the iphone iPhone AMAZON.COM", "microſoft", "Meta platforms (x", "İ App Store"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    every = [mentions._mentions(mentions.places(F.col("t"), F.lit(mentions.mention_pattern(c))), F.lit(c), lambda m, c=c: F.when(F.ltrim(m["hit"], F.lit("$")) == c, "ticker").otherwise("name")) for c in C.COMPANIES]
    every += [mentions._mentions(mentions.places(F.col("t"), F.lit(p)), F.lit(c), lambda m: F.lit("product")) for c in C.COMPANIES if (p := mentions.product_pattern(c))]
    got = df.select(mentions.registered(F.col("t")).alias("a"), F.concat(*every).alias("b"))
    rows = got.collect()
    assert all(r.a == r.b for r in rows) and [len(r.a) for r in rows][:2] == [0, 3]
    plan = df.select(mentions.registered(F.col("t")))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains(" in plan  # the cheap search stands before the patterns


def test_overlapping_mentions(spark):
    kind = mentions.MENTION.replace("struct<", "array<struct<", 1) + ">"
    df = spark.createDataFrame([([("A", 0, 5, "name", False), ("B", 2, 8, "ticker", True), ("C", 8, 9, "name", False), ("D", 8, 12, "name", False)],)], f"m {kind}")
    assert [m.ticker for m in df.select(mentions.resolve(F.col("m")).alias("m")).first().m] == ["B", "D"]


def test_question_mentions_ignore_products(spark):
    assert one(spark, mentions.find_tickers(F.col("t")), t="Is nvidia or the iPhone better than Intel and Intel?") == ["INTC", "NVDA"]
    assert one(spark, mentions.canonical(F.col("t")), t=" google ") == "GOOGL" and one(spark, mentions.display_name(F.col("t")), t="zz") == "ZZ"


@pytest.mark.parametrize(("title", "lead", "want"), [("Chips (PRNewswire)", "", "press_release"), ("Nvidia price target raised", "", "analyst_note"), ("Stock Market Today: up", "", "market_wrap"), ("7 Best Chips", "", "listicle"), ("Should You Buy Intel?", "", "opinion"), ("Intel rises", "", "news"), ("x", "today announced a thing", "press_release"), ("x", "price target", "news")])
def test_article_type(spark, title, lead, want):
    assert one(spark, relevance.article_type(F.col("t"), F.col("b"))[0], t=title, b=lead) == want


def test_salience_and_tiers(spark):
    title = spark.createDataFrame([("a", "X", 0, False), ("a", "Y", 9, False)], "article_id string, ticker string, start int, tagged boolean")
    body = spark.createDataFrame([("a", "X", 0, True), ("a", "X", 50, False), ("a", "Y", 900, False)], title.schema)
    words = spark.createDataFrame([("a", 100, 360)], "article_id string, words int, lead_end int")
    got = {r.ticker: r for r in relevance.salience(title, body, words).collect()}
    assert got["X"].score == 0.95 and got["X"].title_subject and got["X"].mentions_per_100_words == 2.0
    assert not got["Y"].in_lead and got["Y"].relative_share == 0.5 and got["Y"].score == pytest.approx(0.275, abs=6e-4)
    t = lambda s, k, i=False: one(spark, relevance.tier(F.lit(i), F.lit(s), F.col("k")), k=k)
    assert [t(0.5, "news"), t(0.79, "listicle"), t(0.49, "press_release"), t(0.9, "news", True)] == ["primary", "mentioned", "incidental", "incidental"]


def test_enumeration_query_reads_every_event(spark, tmp_path):
    rows = [(100_000 + i, 1, t) for i, t in enumerate("abc")] + [(200_000, 1, "a")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert sorted(map(tuple, QUERIES["enumeration_range_join"](spark, str(tmp_path)).collect())) == [(1, "b"), (1, "c")]


def test_enumerations_and_focus(spark):
    m = "article_id string, ticker string, start int, tagged boolean"
    body = spark.createDataFrame([("a", f"T{i}", i, False) for i in range(8)] + [("a", "T0", 50, False)], m)
    title = spark.createDataFrame([("a", "T1", 0, False)], m)
    s = spark.createDataFrame([("a", 0, 0, 20), ("a", 1, 40, 60), ("b", 0, 0, 9)], "article_id string, number int, start int, end int")
    assert {r.ticker for r in relevance.enumeration_only(body, s, title).collect()} == {f"T{i}" for i in range(2, 8)}
    primary = spark.createDataFrame([("a", "T0")], "article_id string, ticker string")
    assert sorted((r.article_id, r.number) for r in relevance.focus_sentences(s, body, primary).collect()) == [("a", 0), ("a", 1), ("b", 0)]


@pytest.mark.parametrize(("text", "want"), [("beat gains record", "positive"), ("not strong, weak and fell", "negative"), ("beat", "neutral"), ("gains record strong miss loss weak", "mixed")])
def test_tone(spark, text, want):
    p, n = relevance.tone_counts(F.array("t"))
    assert one(spark, relevance.tone_label(p, n), t=text) == want


def test_events_keep_their_order(spark):
    assert one(spark, relevance.events(F.array("t")), t="Inflation fell; earnings beat estimates; CEO resigned; shares rose") == ["earnings", "stock_move", "leadership", "macro"]


# --- Index, search, coverage ------------------------------------------------------------------------------------------
def test_chunks():
    count = lambda t: len(t.split())
    text = " ".join(f"Sentence number {i} is here." for i in range(40))
    got = chunking.pieces(text, 20, 1, count)
    assert all(count(c) <= 20 for c in got) and all(S.split(a)[-1] == S.split(b)[0] for a, b in zip(got, got[1:], strict=False))
    assert list(dict.fromkeys(s for c in got for s in S.split(c))) == S.split(text)
    assert chunking.pieces("w " * 50, 20, 0, count) == [("w " * 20).strip(), ("w " * 20).strip(), ("w " * 10).strip()]


def test_sync(spark):
    s = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "id string, hash string")
    c = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "id string, hash string")
    assert index.sync_report(index.sync_plan(s, c)).first().asDict() == {"written": 2, "unchanged": 1, "stale_removed": 1}
    assert sorted(map(tuple, index.sync(s, c).collect())) == [("a", "1"), ("b", "9"), ("d", "4")]
    assert index.sync_report(index.sync_plan(c, c)).first().asDict() == {"written": 0, "unchanged": 3, "stale_removed": 0}


def test_versions(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert not index.is_ready(f"{tmp_path}/t/none", spark) and feeds.current_version(spark, f"{tmp_path}/t") is None
    feeds.upsert(spark, f"{tmp_path}/t", rows)
    feeds.upsert(spark, f"{tmp_path}/t", spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int"))
    now = feeds.current_version(spark, f"{tmp_path}/t")
    assert sorted(map(tuple, spark.read.parquet(now).collect())) == [("a", 1), ("b", 3), ("c", 4)] and index.is_ready(now, spark)


def test_filters_sink_below_ranking(spark):
    assert search.predicate(search.SearchFilters()) is None
    df = spark.range(50).withColumn("embedding", F.array(F.lit(1.0), F.col("id").cast("double")))
    q = df.where("id = 1").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    got = search.dense_top_k(df, q, "id", "embedding", 3, keep=F.col("id") > 40)
    assert [r.id for r in got.orderBy("rank").collect()] == [41, 42, 43]
    assert "WindowGroupLimit" in got._jdf.queryExecution().optimizedPlan().toString()


def test_dense_search_takes_any_number_of_queries(spark):
    df = spark.range(40).withColumn("embedding", F.array(F.lit(1.0), F.col("id").cast("double")))
    q = df.select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    few, many = (search.dense_top_k(df, q, "id", "embedding", 3, max_queries=n).collect() for n in (40, 7))
    assert len(many) == 40 * 3 and sorted(many) == sorted(few)
    plan = search.dense_top_k(df, q, "id", "embedding", 3, max_queries=7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan  # without unusual vectors nothing meets pair by pair


def test_tone_stems_only_words_that_begin_like_one(spark):
    words = [w + s for w in (*C.POSITIVE, *C.NEGATIVE, "the", "ri", "xyz", "glad") for s in ("", "s", "es", "ed", "ing", "ies", "ied", "'", "e")]
    sets = [{T.stem_word(w) for w in ws} for ws in (C.POSITIVE, C.NEGATIVE)]
    df = spark.createDataFrame([(w,) for w in words], "t string").select("t", relevance.tone(F.array("t")).alias("x"))
    assert [tuple(r.x) for r in df.collect()] == [tuple(int(T.stem_word(r.t) in s and T.stem_word(r.t) not in o) for s, o in (sets, sets[::-1])) for r in df.collect()]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # both counts come from one walk over the words


def test_hashed_embedding_counts_buckets_without_a_walk_for_each(spark):
    got = one(spark, providers.hashed_embedding(F.col("t")), t="a b b zz")
    assert len(got) == 64 and abs(sum(x * x for x in got) - 1) < 1e-12 and sorted(round(x * x * 6) for x in got if x) == [1, 1, 4]
    plan = spark.range(1).select(providers.hashed_embedding(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "array_remove" in plan and "filter(" not in plan


@pytest.mark.parametrize("kind", ["long", "string"])
def test_dense_search_by_blocks_equals_all_pairs(spark, monkeypatch, kind):
    import random

    r = random.Random(3)
    vectors = [[round(r.gauss(0, 1), 2) for _ in range(6)] for _ in range(120)]
    vectors += [vectors[5]] * 30 + [[2 * x for x in vectors[6]]] * 4 + [[x + 1e-8 for x in vectors[7]]] * 3 + [None, [1.0, None, 1.0, 1.0, 1.0, 1.0], [1.0, 2.0], [float("nan")] * 6, [1e200] + [1.0] * 5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, embedding array<double>").select(F.col("id").cast(kind).alias("id"), "embedding")
    df = df.unionAll(df.where("id in (5, 9)"))  # ids may repeat
    q = df.where("id % 2 = 1").select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    monkeypatch.setattr(search, "POOL_BLOCK", 6 * 50)
    monkeypatch.setattr(search, "QUERY_BLOCK", 6 * 20)
    for k in (1, 4, 200):
        want, df_got = search.dense_top_k(df, q, "id", "embedding", k, max_queries=1000), search.dense_top_k(df, q, "id", "embedding", k, max_queries=0)
        assert sorted(map(str, df_got.collect())) == sorted(map(str, want.collect()))
    plan = df_got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan  # blocks meet blocks


def test_company_first(spark):
    cols = "query_id int, id string, score double, rank int"
    p = spark.createDataFrame([(1, "a", 0.1, 1), (2, "a", 0.1, 1), (2, "b", 0.1, 2)], cols)
    w = spark.createDataFrame([(1, "z", 0.9, 1), (1, "a", 0.8, 2), (1, "y", 0.7, 3), (2, "z", 0.9, 1)], cols)
    got = search.company_first(p, w, 2).orderBy("query_id", "number").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, "a"), (1, "z"), (2, "a"), (2, "b")]


def test_coverage(spark):
    rows = [(f"i{i}", ["INTC"], ["NVDA"], i == 9) for i in range(6)] + [("i0", ["INTC"], ["INTC"], False), ("m", ["IBM"], [], True)]
    c = spark.createDataFrame(rows, "article_id string, primary_tickers array<string>, mentioned_tickers array<string>, is_stub boolean")
    got = {r.ticker: r for r in coverage.coverage(c, spark.createDataFrame([("INTC",), ("NVDA",), ("IBM",), ("BABA",)], "ticker string")).collect()}
    assert {t: r.level for t, r in got.items()} == {"INTC": "full", "NVDA": "mentions_only", "IBM": "limited", "BABA": "none"}
    assert got["INTC"].primary_articles == 6 and got["INTC"].mention_articles == 0
    said = {r.ticker: r.notice for r in coverage.notice(coverage.coverage(c).withColumn("company", F.col("ticker"))).collect()}
    assert said["IBM"] == "Coverage of IBM in this news set is limited: 1 article focuses on it and 0 articles mention it in passing." and said["INTC"] is None
    assert [r.ticker for r in coverage.most_covered(coverage.coverage(c), 5, ["IBM", "INTC"]).collect()] == ["INTC", "IBM"]


# --- Questions, grounding, evaluation --------------------------------------------------------------------------------
@pytest.mark.parametrize(("q", "want"), [("Should I buy Nvidia?", "advice"), ("Will Apple stock go up", "prediction"), ("What is Apple's current market cap?", "live_data"), ("What happened yesterday?", "timing"), ("Nvidia price target", "price_target"), ("What do analysts say", "analyst_view"), ("Why did Intel jump", "causal"), ("Latest on Intel", "news")])
def test_intents(spark, q, want):
    assert one(spark, questions.intent(F.col("q")), q=q) == want


def test_routes(spark):
    asked = spark.createDataFrame([(1, "What's the weather?"), (2, "What happened today?"), (3, "Intel share price right now"), (4, "News on Alibaba"), (5, "Intel today"), (6, "Alibaba or Intel news")], "question_id int, question string")
    reports = spark.createDataFrame([("INTC", "full"), ("BABA", "none")], "ticker string, level string")
    got = {r.question_id: r.route for r in questions.route(questions.analyze(asked), reports, F.col("question_id") != 1).collect()}
    assert got == {1: "out_of_scope", 2: "timing", 3: "live_data", 4: "not_covered", 5: "retrieve", 6: "retrieve"}
    q, bad = questions.validate(F.col("t"))
    assert one(spark, q, t=" a\n b ") == "a b" and one(spark, bad, t="  ") == "blank" and one(spark, bad, t="x" * 501) == "too_long"


def test_verification(spark):
    answer = "Here is what they say:\n\n- Revenue grew 15% [1]. Shares fell 9% [1].\n- No citation here.\n- Up $1.2B [2][9]. [1] Next is fine.\n\n\nDone [2]."
    a = spark.createDataFrame([(1, answer)], "answer_id int, text string")
    s = spark.createDataFrame([(1, 1, "grew by 15 per cent"), (1, 2, "up 1,200 million")], "answer_id int, number int, text string")
    r = grounding.verify(a, s).first()
    assert r.text.split("\n") == ["Here is what they say:", "", "- Revenue grew 15% [1].", "- Up $1.2B [2]. [1]", "", "Done [2]."]
    assert r.cited_numbers == [1, 2] and [x.reason for x in r.removed] == ["unsupported_number", "uncited", "uncited"]


def test_votes_and_gates(spark):
    reason = lambda v, q, t: one(spark, evaluate.decide_vote(F.col("v"), F.col("q"), F.array("t")), v=v, q=q, t=t)
    text = "The company’s revenue grew by  fifteen percent."
    assert reason("supported", "company's revenue grew by fifteen", text) == "judge_supported" and reason("supported", "revenue", text) == "quote_too_short"
    assert reason("supported", "a quote that is not there at all", text) == "quote_not_found" and reason("unsupported", "", text) == "judge_unsupported"
    votes = spark.createDataFrame([(1, 1, "judge_supported"), (1, 2, "judge_error"), (1, 3, "judge_supported"), (2, 1, "judge_error"), (2, 2, "quote_too_short"), (2, 3, "judge_supported")], "c int, vote_no int, reason string")
    got = {r.c: (r.verdict, r.reason) for r in evaluate.majority(votes, ["c"]).collect()}
    assert got == {1: ("supported", "judge_supported"), 2: ("unsupported", "judge_error")}
    scores = spark.createDataFrame([(1.0,), (0.6,)], "score double")
    assert evaluate.faithfulness_gate(scores).first().passed and evaluate.faithfulness_gate(scores.limit(0)).first().passed
    assert not evaluate.faithfulness_gate(spark.createDataFrame([(1.0,), (0.5,)], "score double")).first().passed


def test_expectations_and_transforms(spark):
    bad = evaluate.expectation_problems(F.col("t"), ["Intel"], ["sell"], ["up", "down"], ["$1.2B"], ["9%"])
    assert one(spark, bad, t="Intel went up 1,200 million") == [] and one(spark, bad, t="Intelligent sell 9%") == ["missing Intel", "unwanted sell", "missing figure $1.2B", "unwanted figure 9%", "missing any of up, down"]
    df = spark.createDataFrame([("5% up", "x"), ("15% up", "y")], "text string, title string")
    assert [tuple(r) for r in evaluate.counterfactual(df, "5%", "7%", ["text"]).collect()] == [("7% up", "x", True), ("15% up", "y", False)]
    assert one(spark, evaluate.outcome_problems(F.lit("disclaimer"), F.col("t"), F.array(F.lit(1)), C.NOT_ADVICE), t="It rose. " + C.NOT_ADVICE) == []


def test_judging_and_integrity(spark, tmp_path):
    a = spark.createDataFrame([(1, "They say:\nUp 5% [1]. Odd 7 [9]. Plain. " + C.NOT_ADVICE)], "answer_id int, text string")
    src = spark.createDataFrame([(1, 1, "rose 5%")], "answer_id int, number int, text string")
    got = {r.sentence: (r.reason, r.cited_texts) for r in evaluate.judged_sentences(a, src, C.FIXED_MESSAGES).collect()}
    assert got == {"They say:": ("skipped", []), "Up 5% [1].": (None, ["rose 5%"]), "Odd 7 [9].": ("unknown_citation", [None]), "Plain.": ("skipped", [])}
    cites = spark.createDataFrame([(1, 1, "c", "gone")], "answer_id int, number int, chunk_id string, link string")
    bad = evaluate.integrity_problems(a, cites, spark.createDataFrame([("c", "rose 5%")], "chunk_id string, text string"), spark.createDataFrame([("l",)], "link string"))
    assert sorted(r.problem for r in bad.collect()) == ["unknown link gone", "unknown mark 9", "unsupported figure 7.000000000000"]
    assert [r.sentence for r in evaluate.stated_valuations(spark.createDataFrame([(1, "Its market cap is $3T. It rose.")], "answer_id int, text string"), ["market cap"]).collect()] == ["Its market cap is $3T."]
    b = spark.createDataFrame([(1, "(NYSE: X) (NYSE: X)")], "id int, text string")
    assert [r.tag for r in evaluate.lost_tags(b, spark.createDataFrame([(1, "(NYSE: X)")], "id int, text string")).collect()] == ["(NYSE: X)"]
    evaluate.write_run(bad, f"{tmp_path}/run")
    assert spark.read.json(f"{tmp_path}/run").count() == 3


def test_feed_and_frames(spark, tmp_path):
    feed = {"INTC": [{"title": "a", "link": "l", "full_text": "t"}, {"title": "b", "link": "l", "ticker": "X", "full_text": "u"}], "IBM": [{"title": "a", "link": "l", "full_text": "t"}]}
    (tmp_path / "f.json").write_text(json.dumps(feed, indent=1))
    rows = feeds.read_feed(spark, str(tmp_path / "f.json")).orderBy("seq").collect()
    assert [(r.title, r.ticker) for r in rows] == [("a", "INTC"), ("b", "X"), ("a", "IBM")]
    stream = ": hi\r\nevent: meta\r\ndata: {\r\ndata:  1}\r\n\r\ndata:x\n\nevent: half"
    assert [tuple(x) for x in one(spark, feeds.parse_sse(F.col("s")), s=stream)] == [("meta", "{\n 1}"), ("message", "x")]


def test_rule_files_are_validated():
    good = rules.parse_noise_rules('[[noise_rules]]\nname = "a"\ncategory = "x"\npattern = "b+"\n[[noise_rules]]\nname = "c"\nstrategy = "to_end"\npattern = "d"\ntruncation = true')
    assert [(r.name, r.strategy, r.truncation) for r in good] == [("a", "span", False), ("c", "to_end", True)]
    assert cleaning.remove_noise("a bbb c", "", cleaning.compiled(rules=good[:1]))[0] == "a   c"
    for bad in ('name = "a"\nstrategy = "no"\npattern = "b"', 'name = "a"\npattern = "("', 'name = "a"\npattern = "b"\nodd = 1'):
        with pytest.raises(ValueError):
            rules.parse_noise_rules("[[noise_rules]]\n" + bad)
    assert rules.parse_registry('{"X": {"name": "Ex", "aliases": ["Ex", "E"], "indexed": true}}') == {"X": ("Ex", True, ["Ex", "E"], [])}
    for bad in ('{"x": {"name": "a"}}', '{"X": {}}', '{"X": {"name": "A"}, "Y": {"name": "a"}}'):
        with pytest.raises(ValueError):
            rules.parse_registry(bad)
    assert rules.settings({"CORPUSQ_TOP_K": "5"}).top_k == 5
    with pytest.raises(ValueError):
        rules.settings({"CORPUSQ_TOP_K": "50"})


# --- The stored index and the online plan ---------------------------------------------------------------------------
def chunk_rows(spark, n=6, stub=False):
    rows = [(f"c{i}", f"a{i}", 0, f"h{i}", f"Title {i}", f"l{i}", "", f"Intel sold 2 chips. More.", f"Title: {i}\n\nIntel sold 2 chips. More.", stub, ["INTC"], ["NVDA"], ["product"], "neutral", "news") for i in range(n)]
    return spark.createDataFrame(rows, store.CHUNK)


def test_stored_index_is_reused(spark, tmp_path):
    path = f"{tmp_path}/index"
    assert store.load(spark, path).chunks.isEmpty() and store.health(spark, path) == {"status": "degraded", "store": "up", "index_ready": False}
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        seen.add(len(texts))
        assert len(texts) <= 4
        return [[float(len(t)), 1.0] for t in texts]

    rows = chunk_rows(spark)
    assert store.sync(spark, path, rows, providers.encoder(embed, 4)).first().asDict() == {"written": 6, "unchanged": 0, "stale_removed": 0}
    first = feeds.current_version(spark, path)
    changed = rows.where("id <> 'c5'").withColumn("hash", F.when(F.col("id") == "c0", "new").otherwise(F.col("hash")))
    assert store.sync(spark, path, changed, providers.encoder(embed, 4)).first().asDict() == {"written": 1, "unchanged": 4, "stale_removed": 1}
    assert seen.value == 7  # only the changed chunk was encoded again
    now = store.load(spark, path)
    assert now.chunks.count() == now.vectors.count() == 5 and now.postings.select("id").distinct().count() == 5
    assert store.health(spark, path)["status"] == "ok" and spark.read.parquet(f"{first}/chunks").count() == 6
    back = store.from_payload(store.to_payload(now.chunks))
    assert sorted(r.title for r in back.collect()) == [f"Title {i}" for i in range(5)]
    store.drop_versions_before(spark, path, feeds.current_version(spark, path))
    assert feeds.current_version(spark, path) != first and not index.is_ready(f"{first}/chunks", spark)

    def broken(texts):
        raise providers.EmbeddingError("service is down")

    with pytest.raises(Exception, match="service is down"):
        store.build(rows, providers.encoder(broken)).vectors.collect()


def asked(spark, *questions_):
    return spark.createDataFrame(list(enumerate(questions_)), "question_id int, question string")


def say(text, error=None):
    return lambda requests: requests.select("question_id", F.lit(text).alias("draft"), F.lit(error).cast("string").alias("error"), F.lit(1).alias("tokens"))


def test_online_exits(spark):
    built = store.build(chunk_rows(spark))
    qs = asked(spark, "How is the weather?", "What happened today?", "What is Intel's current market cap?", "News on Alibaba?", "Why did Intel stock jump?", "Should I buy Intel?", "What about Nvidia today?")
    ports = online.Ports(draft=say("Intel sold 2 chips [1].\n\nIt sold 99 chips [1].\nNothing cited."), guard=lambda q: F.when(q.contains("weather"), False))
    got = {r.question_id: r for r in online.respond(qs, built, ports).collect()}
    assert {i: r.route for i, r in got.items()} == {0: "out_of_scope", 1: "timing", 2: "live_data", 3: "not_covered", 4: "answered", 5: "answered", 6: "answered"}
    assert got[0].text == C.OUT_OF_SCOPE and got[3].text == "None of the articles in this dataset mention Alibaba."
    assert got[1].text == C.NO_DATES + "\n\nInstead, here's what the 6 articles cover most:\n- Intel: 6 articles\n\nAsk me about any of these companies for a summary of their news."
    assert got[2].text.startswith("I don't have live market data, and the articles don't state Intel's current market cap") and not got[2].cited_numbers
    assert got[4].removed == 2 and [c.number for c in got[4].citations] == [1] and "99" not in got[4].text
    assert got[5].text.endswith(C.NOT_ADVICE) and got[5].notices == [C.NOT_ADVICE]
    assert got[6].text.startswith(C.NO_DATES + "\n\nThere's no dedicated news about Nvidia in this dataset")
    frames = {}
    for r in online.events(online.respond(qs, built, ports)).orderBy("question_id", "seq").collect():
        frames.setdefault(r.question_id, []).append(r)
    assert [r.event for r in frames[0]] == ["meta", "final"] and [r.event for r in frames[4]] == ["meta", "sources", "delta", "delta", "final"]
    assert all("99" not in r.data for r in frames[4] if r.event in ("delta", "final"))  # what is not supported is never sent
    assert json.loads(frames[4][-1].data)["citations"][0]["chunk_id"] == got[4].chunk_ids[0] and frames[4][0].frame.startswith("event: meta\ndata: {")
    log = [json.loads(r.line) for r in online.run_log(online.respond(qs, built, ports), 12).collect()]
    assert all(x["latency_ms"] == 12 for x in log) and sum(x["out_of_scope"] for x in log) == 1


def test_online_failures(spark):
    built, qs = store.build(chunk_rows(spark, stub=True)), asked(spark, "Why did Intel stock jump?")

    def down(texts):
        raise providers.EmbeddingError("no vectors")

    one_ = lambda ports, index_=built: online.respond(qs, index_, ports).first()
    r = one_(online.Ports(encode=providers.encoder(down)))
    assert (r.route, r.error) == ("retrieval_error", "no vectors") and r.text.endswith(C.ANSWER_UNAVAILABLE)
    r = one_(online.Ports(draft=say(None, "model is down")))
    assert (r.route, r.error) == ("model_error", "model is down") and r.text.endswith(C.ANSWER_UNAVAILABLE) and r.text.startswith("Coverage of Intel")
    r = one_(online.Ports(wrap=lambda p: p.where("false")))
    assert r.route == "nothing_found" and r.text.endswith(C.NO_GROUNDED_ANSWER)
    r = one_(online.Ports(draft=say("Nothing cited.")))
    assert r.route == "answered" and C.NO_GROUNDED_ANSWER in r.text and not r.cited_numbers
    r = one_(online.Ports(draft=say("Intel sold 2 chips [1].")))
    assert r.text.endswith(C.PARTIAL_SOURCES)
    guard = online.respond(asked(spark, "How is it?"), built, online.Ports(guard=lambda q: F.lit(None).cast("boolean"))).first()
    assert guard.route == "answered"  # a guard that fails lets the question through
    swapped = one_(online.Ports(wrap=lambda p: evaluate.counterfactual(p, "chips", "boats", ["text"]), draft=lambda rq: providers.extractive_answer(rq, 2)))
    assert "boats" in swapped.text and "chips" not in swapped.text
    said = online.respond(qs, built, online.Ports(draft=lambda rq: rq.select("question_id", F.col("prompt").alias("draft"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("tokens")))).select("lines").first()
    assert said is not None


def test_model_reads_guidance_and_labels(spark):
    built = store.build(chunk_rows(spark, 2, stub=True))
    seen = {}

    def draft(requests):
        seen["prompt"] = requests.first().prompt
        return say("x [1].")(requests)

    online.respond(asked(spark, "News on Nvidia?"), built, online.Ports(draft=draft)).collect()
    assert "Coverage of Nvidia is thin." in seen["prompt"] and "[1] (PARTIAL; mentions the company only in passing)\n" in seen["prompt"] and "Question: News on Nvidia?" in seen["prompt"]


def test_streamed_lines_are_verified(spark, tmp_path):
    df = spark.createDataFrame([("q", 0, "Up 5% [1].\nUp 6", False), ("q", 1, "% [1].\n", False), ("q", 2, "End [1].", True)], "answer_id string, seq int, delta string, last boolean")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    sources = spark.createDataFrame([("q", 1, "rose 5%")], "answer_id string, number int, text string")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    w = lines.verified_lines(stream, sources, lambda out: out.write.mode("append").parquet(f"{tmp_path}/out"))
    q = w.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    q.stop()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == [("q", 0, "Up 5% [1]."), ("q", 2, "End [1].")]


def test_lines(spark, tmp_path):
    assert lines.split_lines("ab", ["c\nd", "\n\ne"]) == (["abc", "d", ""], "e")
    df = spark.createDataFrame([("q", 0, "a\nb", False), ("q", 1, "c\n", False), ("q", 2, "end", True)], "answer_id string, seq int, delta string, last boolean")
    want = [("q", 0, "a"), ("q", 1, "bc"), ("q", 2, "end")]
    assert sorted(map(tuple, lines.batch_lines(df).collect())) == want
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    out = lines.completed_lines(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("lines").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(90)
    q.stop()
    assert sorted(map(tuple, spark.table("lines").collect())) == want


def test_entry_runs_without_the_training_data_part():
    """With the subpackage and the pipeline out of reach, the rest imports and keeps its queries."""
    code = "import sys\nsys.modules['corpusq.llm'] = sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert q and not any(n.startswith('op') or n == 'pipeline' for n in q) and set(e.oracle_sql()) <= set(q)\nassert not any(m.startswith('corpusq.llm.') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
