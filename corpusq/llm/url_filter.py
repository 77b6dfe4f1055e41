"""URL judging: host/path rules first, else logistic regression on hashed character n-grams."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusq.llm.common import ship

# The labelled URL table: hosts by hand under names reserved for documentation and tests, each with some paths.
BLOCKED_HOSTS = """
lucky-casino-bonus.example best-poker-rooms.example winbigslots.example sportsbet24.example roulette-online-now.example
jackpot-city-free.example cheap-pills-shop.example canadian-pharma-rx.example buy-viagra-online.example weightlosspills.example
fast-cash-loans.example paydayloan-today.example debt-relief-free.example crypto-profit-bot.example getrichquick.example
hot-singles-dating.example adult-cams-live.example xxx-video-tube.example free-porn-clips.example sexy-chat-rooms.example
warez-downloads.example keygen-crack-serial.example torrent-movies-free.example cracked-games.example nulled-themes.example
ads.banner-network.example track.clickserver.example popunder-ads.example adserver7.example click-redirect.example
seo-link-farm.example cheap-backlinks.example spam-blog-farm.example replica-watches.example fake-handbags-outlet.example
free-iphone-winner.example prize-claim-now.example survey-rewards.example verify-account-login.example update-your-bank.example
casino.freebets.test slots.bonus-spins.test poker.win-money.test pills.discountmeds.test loans.instant-cash.test
xxx.camgirls.test dating.meet-now.test ads.trackpixel.test cdn.popads.test win.free-gift-card.test
""".split()
ALLOWED_HOSTS = """
city-library.example www.naturalhistorymuseum.example riverside-school.example botany-department.example open-archive.example
local-news-daily.example weather-service.example recipes-from-home.example mountain-hiking-club.example chess-federation.example
physics-lectures.example journal-of-geology.example poetry-review.example town-council.example fire-department.example
public-transport.example maps-and-routes.example gardeners-forum.example beekeepers.example woodworking-notes.example
python-tutorials.example linux-users-group.example opensource-docs.example compiler-blog.example database-internals.example
orchestra-tickets.example photography-club.example film-archive.example childrens-hospital.example patient-advice.example
bakery-on-main-street.example bicycle-repair.example farmersmarket.example language-school.example travel-diary.example
www.astronomy-society.test blog.marine-biology.test docs.map-server.test wiki.model-trains.test forum.birdwatch.test
history.old-bridges.test news.county-herald.test library.stateuni.test shop.handmade-pottery.test en.encyclopedia.test
kranor.test belthom.test shavildo.test ormetun.test quindale.test tarvessa.test lomirek.test ashpendon.test vereth.test oldumar.test
""".split()
BLOCKED_PATHS = ("/bonus/free-spins", "/buy/cheap?ref=1", "/win/now/claim.php", "/click/redirect/123", "/index.html", "/", "/xxx/gallery/12", "/a/77")
ALLOWED_PATHS = ("/about", "/2020/05/spring-report.html", "/docs/install", "/articles/1234", "/index.html", "/", "/staff/contact", "/a/77")


def labelled_urls(hosts_blocked: list[str] = BLOCKED_HOSTS, hosts_allowed: list[str] = ALLOWED_HOSTS) -> list[tuple[str, str, int]]:
    """The small labelled table (host, path, 1 = block): each host with four paths, by turns."""
    sides = ((1, hosts_blocked, BLOCKED_PATHS), (0, hosts_allowed, ALLOWED_PATHS))
    return [(h, paths[(i + 2 * j) % len(paths)].split("?")[0], label) for label, hosts, paths in sides for i, h in enumerate(hosts) for j in range(4)]


def grams(field: str, text: str, lo: int, hi: int, bits: int) -> np.ndarray:
    """Sorted distinct bucket numbers of the character n-grams of one field (host or path), with its borders marked."""
    b = f"^{text}$".encode("utf-8", "surrogatepass")
    seed = zlib.crc32(field.encode())
    out = {zlib.crc32(b[i : i + n], seed) & ((1 << bits) - 1) for n in range(lo, hi + 1) for i in range(len(b) - n + 1)}
    return np.unique(np.fromiter(out, np.int64, len(out)))


def host_text(host: str) -> str:
    """What a host's n-grams are of: without ``www.`` and the last label, which says little."""
    host = host.removeprefix("www.")
    return host.rpartition(".")[0] or host


def path_text(path: str) -> str:
    """What a path's n-grams are of: every number is 0."""
    return re.sub(r"[0-9]+", "0", path)


def features(host: str, path: str, lo: int, hi: int, bits: int) -> np.ndarray:
    return np.unique(np.concatenate([grams("h", host_text(host), lo, hi, bits), grams("p", path_text(path), lo, hi, bits)]))


def train(rows: list[tuple[str, str, int]], lo: int = 3, hi: int = 5, bits: int = 18, steps: int = 300, l2: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the regression; full-batch gradient descent, the same on every machine."""
    feats = [features(h, p, lo, hi, bits) for h, p, _ in rows]
    y = np.array([r[2] for r in rows], float)
    idx, owner = np.concatenate(feats), np.repeat(np.arange(len(rows)), [len(f) for f in feats])
    scale = 1 / np.sqrt(np.bincount(owner, minlength=len(rows)))
    balance = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(1 << bits), 0.0
    for _ in range(steps):
        z = np.bincount(owner, w[idx], len(rows)) * scale + b
        g = (1 / (1 + np.exp(-z)) - y) * balance
        w -= 20 * (np.bincount(idx, (g * scale)[owner], 1 << bits) + l2 * w)
        b -= 2 * g.sum()
    return w, b


@functools.lru_cache(1)
def fit() -> tuple[np.ndarray, float]:
    return train(labelled_urls())


class Judge:
    """Scores hosts and paths; sums of a batch's distinct hosts and paths are made once."""

    def __init__(self, weights: np.ndarray, bias: float, lo: int = 3, hi: int = 5):
        self.w, self.b, self.lo, self.hi, self.bits = weights, bias, lo, hi, len(weights).bit_length() - 1

    def sums(self, field: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Summed weight and number of the n-grams of each text."""
        seen = dict.fromkeys(texts)
        for t in seen:
            g = grams(field, t, self.lo, self.hi, self.bits)
            seen[t] = (self.w[g].sum(), len(g))
        both = np.array([seen[t] for t in texts], float).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def score(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        (hs, hn), (ps, pn) = self.sums("h", [host_text(h) for h in hosts]), self.sums("p", [path_text(p) for p in paths])
        n = np.maximum(hn + pn, 1)
        z = np.where([bool(h or p) for h, p in zip(hosts, paths, strict=True)], (hs + ps) / np.sqrt(n), 0.0) + self.b
        return 1 / (1 + np.exp(-z))


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lower, F.lit("")), F.coalesce(path, F.lit(""))


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule ``host/path`` that fits, else nulls. A rule fits its host and all subdomains."""
    rule = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first, as it wraps the rest
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, score.

    ``rules``: (``host/path``, ``allow`` or ``block``); the longest fitting rule decides. Elsewhere the
    regression does: ``block`` from ``threshold`` on. Null urls and urls without ``://`` have an empty host and
    path, fit no rule and are scored as such (the bias alone). Equal urls get equal verdicts; repeated rows are
    each judged, ids may be null; urls are read whole, however long; an empty table gives an empty result;
    further columns, whatever their names, are ignored. Rows that a rule decides have no score (null). No shuffle.
    """
    ship(pages.sparkSession)
    judge = Judge(*fit())
    host, path = split_url(F.col(url_col))
    rule, said = match_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")).withColumns({"rule": rule, "said": said})
    schema = "page_id " + rows.schema["page_id"].dataType.simpleString() + ", host string, path string, rule string, said string, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            open_ = batch.column(4).is_null()
            hosts, paths = (batch.column(i).filter(open_).to_pylist() for i in (1, 2))
            out = np.full(batch.num_rows, np.nan)
            out[np.nonzero(open_.to_numpy(zero_copy_only=False))[0]] = judge.score(hosts, paths)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, mask=~open_.to_numpy(zero_copy_only=False))], ["page_id", "host", "path", "rule", "said", "score"])

    scored = rows.mapInArrow(score, schema)
    return scored.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= threshold, "block").otherwise("allow")).alias("verdict"), "score")
