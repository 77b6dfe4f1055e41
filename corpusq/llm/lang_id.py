"""Language identification by interpolated Kneser-Ney character models.

One model per language over the letters of words (``^word$``, lower-cased). Counting, discounts and
interpolation run at fitting time; what is stored is, for all languages together, one sorted array of n-gram
hashes with a row of final log-probabilities (one column per language) and one sorted array of context hashes
with the log-weights of backing off. A character costs one search unless it backs off.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusq.functions.partitions import spread
from corpusq.llm.common import Words, fold, mix64, ship

WORD = re.compile(r"[^\W\d_]+")
#: Chunks (white-space-separated, of up to LONG bytes) a worker remembers; a full memory starts anew.
MEMORY, LONG = 300_000, 256


@dataclass
class Model:
    langs: list[str]
    order: int
    gram_keys: np.ndarray  # sorted uint64
    gram_logp: np.ndarray  # rows of len(langs)
    ctx_keys: np.ndarray
    ctx_logw: np.ndarray
    floor: np.ndarray  # log-probability of an unseen character, by language
    sharpness: float = 8.0
    reject_above: np.ndarray | None = None  # by language: cross-entropy (nats a character) in it, as the best one
    spread: np.ndarray | None = None  # by language: what the limit rises by for a text of one character


def words_of(text: str) -> list[str]:
    """Runs of letters, however long, in lower case."""
    return WORD.findall(text.lower())


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of ``^word$`` one after another, and each word's length with both marks."""
    joined = "".join(f"^{w}$" for w in words)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64), np.array([len(w) + 2 for w in words], np.int64)


def _hashes(codes: np.ndarray, place: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order: the hash of the n-gram that ends at each character (0 where the word is too short)."""
    out = [mix64(codes + np.uint64(1))]
    for n in range(2, order + 1):
        before = np.append(np.uint64(0), out[-1][:-1])
        h = mix64(before * np.uint64(0x9E3779B97F4A7C15) + codes + np.uint64(n))
        out.append(np.where(place >= n - 1, h, np.uint64(0)))
    return out


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
    return at, (keys[at] == h if len(keys) else np.zeros(len(h), bool))


def fit_counts(counts: dict[str, Counter], order: int = 5) -> Model:
    """Models from word counts by language. Modified only by what a Kneser-Ney model needs: lower orders count distinct left extensions."""
    langs = sorted(counts)
    grams: list[dict[int, np.ndarray]] = [{} for _ in range(order + 1)]
    ctxs: list[dict[int, np.ndarray]] = [{} for _ in range(order + 1)]
    stats = []
    for lang in langs:
        words = sorted(counts[lang])
        codes, size = _codes(words)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
        weight = np.repeat(np.array([counts[lang][w] for w in words], float), size)
        hs = _hashes(codes, place, order)
        # Raw counts at the highest order and for n-grams that begin a word; distinct left extensions elsewhere.
        per = []
        for n in range(1, order + 1):
            ok = (place >= n - 1) & (place > 0)
            h, ctx = hs[n - 1][ok], (np.append(np.uint64(0), hs[n - 2][:-1])[ok] if n > 1 else np.zeros(ok.sum(), np.uint64))
            key, first, inv = np.unique(h, return_index=True, return_inverse=True)
            c = np.bincount(inv, weight[ok], len(key))
            if n < order:
                begins = (place[ok] == n - 1)[first]
                longer = (place >= n) & (place > 0)
                pairs = np.unique(np.stack([hs[n][longer], hs[n - 1][longer]], 1), axis=0)[:, 1] if longer.any() else np.zeros(0, np.uint64)
                k2, c2 = np.unique(pairs, return_counts=True)
                ext = np.zeros(len(key))
                ext[np.searchsorted(key, k2)] = c2
                c = np.where(begins & (n > 1), c, np.maximum(ext, 1))
            per.append((key, ctx[first], c))
        stats.append(per)
    alphabet = len(set().union(*(set("".join(c)) for c in counts.values()))) + 2 if counts else 2
    # Final probabilities from short to long, for the union of n-grams of all languages.
    L = len(langs)
    floor = np.full(L, -np.log(alphabet + 1.0))
    lower_keys, lower_p = np.zeros(0, np.uint64), np.zeros((0, L))
    all_keys, all_p, all_ck, all_cw = [], [], [], []
    for n in range(1, order + 1):
        keys = np.unique(np.concatenate([s[n - 1][0] for s in stats])) if L else np.zeros(0, np.uint64)
        ctx_of, low_of = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
        for s, lang in zip(stats, langs, strict=True):
            ctx_of[np.searchsorted(keys, s[n - 1][0])] = s[n - 1][1]
        if n > 1:  # the n-gram without its first character
            for lang in langs:
                words = sorted(counts[lang])
                codes, size = _codes(words)
                place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
                hs = _hashes(codes, place, n)
                ok = (place >= n - 1) & (place > 0)
                low_of[np.searchsorted(keys, hs[n - 1][ok])] = hs[n - 2][ok]
        ck = np.unique(ctx_of)
        at_ctx = np.searchsorted(ck, ctx_of)
        p, w = np.zeros((len(keys), L)), np.ones((len(ck), L))
        at_low, ok_low = _find(lower_keys, low_of)
        low_p = np.where(ok_low[:, None], lower_p[at_low], np.exp(floor)) if n > 1 else np.exp(np.broadcast_to(floor, (len(keys), L)))
        for j, s in enumerate(stats):
            key, ctx, c = s[n - 1]
            n1, n2 = (c == 1).sum(), (c == 2).sum()
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            i, at = np.searchsorted(ck, ctx), np.searchsorted(keys, key)
            total, kinds = np.bincount(i, c, len(ck)), np.bincount(i, minlength=len(ck))
            seen = total > 0
            w[seen, j] = d * kinds[seen] / total[seen]
            p[at, j] = np.maximum(c - d, 0) / total[i]
        p += w[at_ctx] * low_p
        all_keys.append(keys), all_p.append(p)
        if n > 1:
            all_ck.append(ck), all_cw.append(w)
        else:
            floor = floor + np.log(w[0]) if len(w) else floor
        lower_keys, lower_p = keys, p
    gk, ck = np.concatenate(all_keys), np.concatenate(all_ck)
    g, c = np.argsort(gk, kind="stable"), np.argsort(ck, kind="stable")
    return Model(langs, order, gk[g], np.log(np.concatenate(all_p)[g]), ck[c], np.log(np.concatenate(all_cw)[c]), floor)


def score_words(m: Model, words: list[str]) -> np.ndarray:
    """Summed log-probability of each word by language."""
    if not words:
        return np.zeros((0, len(m.langs)))
    codes, size = _codes(words)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    hs = _hashes(codes, place, m.order)
    out = np.zeros((len(codes), len(m.langs)))
    open_ = np.nonzero(place > 0)[0]
    for n in range(m.order, 0, -1):
        here = open_[place[open_] >= n - 1]
        if not len(here):
            continue
        at, hit = _find(m.gram_keys, hs[n - 1][here])
        out[here[hit]] += m.gram_logp[at[hit]]
        if n > 1:
            miss = here[~hit]
            at, ok = _find(m.ctx_keys, hs[n - 2][miss - 1])
            out[miss[ok]] += m.ctx_logw[at[ok]]
        done = np.zeros(len(codes), bool)
        done[here[hit]] = True
        open_ = open_[~done[open_]]
    out[open_] += m.floor
    return np.add.reduceat(out, np.cumsum(size) - size)


class Scorer:
    """Scores texts; remembers the sums of chunks between white space."""

    def __init__(self, model: Model):
        self.m, self.row = model, {}
        self.sums = np.zeros((0, len(model.langs) + 1))

    def chunk_sums(self, chunks: list[bytes]) -> np.ndarray:
        """Per chunk: summed log-probability by language, and the number of scored characters."""
        if len(self.row) > MEMORY:
            self.row, self.sums = {}, self.sums[:0]
        new = [c for c in chunks if c not in self.row]
        per = [words_of(c.decode("utf-8", "replace")) for c in new]
        flat = Words()
        idx = [flat[w] for ws in per for w in ws]
        owner = np.repeat(np.arange(len(new)), [len(ws) for ws in per])
        uniq = list(flat)
        table = np.concatenate([score_words(self.m, uniq), np.array([[len(w) + 1.0] for w in uniq]).reshape(-1, 1)], 1)
        got = np.zeros((len(new), table.shape[1]))
        np.add.at(got, owner, table[idx] if idx else table[:0])
        short = [i for i, c in enumerate(new) if len(c) <= LONG]
        self.row.update(zip([new[i] for i in short], range(len(self.sums), len(self.sums) + len(short)), strict=True))
        self.sums = np.concatenate([self.sums, got[short]])
        long = {c: i for i, c in enumerate(new) if len(c) > LONG}
        if not long:
            return self.sums[[self.row[c] for c in chunks]]
        return np.stack([got[long[c]] if c in long else self.sums[self.row[c]] for c in chunks])

    def texts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy by language (nats a character) and scored characters of each text."""
        chunks, flat, ends = Words(), [], [0]
        for t in texts:
            if t:
                flat.extend(map(chunks.__getitem__, t.split()))
            ends.append(len(flat))
        sums = self.chunk_sums(list(chunks))
        idx, ends = np.array(flat, np.int64), np.array(ends)
        out = np.zeros((len(texts), len(self.m.langs) + 1))
        full = np.nonzero(np.diff(ends))[0]
        if len(full):
            out[full] = np.add.reduceat(sums[idx], ends[full])
        n = out[:, -1]
        return -out[:, :-1] / np.maximum(n, 1)[:, None], n


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def calibrate(m: Model, h: np.ndarray, n: np.ndarray, langs: list[str]) -> Model:
    """Sharpness by maximum likelihood and limits of rejection, from labelled texts that made no counts.

    ``h``: cross-entropies by language, ``n``: scored characters. The sharpness is the least one whose loss is within
    0.001 of the best. A text is rejected if the cross-entropy in its best language exceeds that language's limit: the
    99th percentile of its calibration texts and as much again as that lies above their median, and for short
    texts, whose cross-entropy varies more, a share of its spread that falls with the root of the length.
    """
    use = n > 0
    h, n, y = h[use], n[use], np.array([m.langs.index(x) for x in langs], int)[use]
    if not len(y):
        return m
    grid = [1, 2, 4, 8, 16, 32]
    loss = [-np.log(_softmax(-h * g)[np.arange(len(y)), y] + 1e-12).mean() for g in grid]
    m.sharpness = float(next(g for g, x in zip(grid, loss, strict=True) if x <= min(loss) + 1e-3))
    m.reject_above, m.spread = np.full(len(m.langs), np.inf), np.zeros(len(m.langs))
    for j in range(len(m.langs)):
        own, size = h[y == j, j], n[y == j]
        if len(own) >= 10:
            middle, high = np.quantile(own, (0.5, 0.99))
            m.reject_above[j] = 2 * high - middle + 0.25
            m.spread[j] = 4 * np.sqrt((size * (own - middle) ** 2).mean())
    return m


def too_strange(m: Model, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Texts beyond the limit of their best language; none without a calibration."""
    if m.reject_above is None:
        return np.zeros(len(h), bool)
    best = h.argmin(1)
    return h.min(1) > m.reject_above[best] + m.spread[best] / np.sqrt(np.maximum(n, 1))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 600, max_words: int = 60_000, order: int = 5) -> Model:
    """Fit on a sample of labelled rows outside the held-out fold.

    The bounds are parameters: about ``per_lang`` whole documents of each language (by a hash of the id, all if there
    are fewer), however long, and of their words the ``max_words`` most frequent ones of each language, so neither
    work nor memory grows with the corpus. A fifth of the sample (by hash) calibrates; executors count the words
    of the rest, and one task makes the model of the counts. Only the model and the
    cross-entropies of the calibration texts reach the driver. Null texts and null languages teach nothing;
    without labelled rows the only language is ``und``.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id") != 0))
    # The counts need narrow columns only.
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return fit_counts({"und": Counter()}, order)
    u = F.xxhash64(F.lit("sample"), "doc_id").bitwiseAND(F.lit(2**40 - 1)) / F.lit(float(2**40))
    pick = F.lit(False)
    for lang, n in sizes.items():
        pick = pick | ((F.col("lang") == lang) & (u < min(1.0, per_lang / n)))
    sample, calibrates = rows.where(pick), u * 5 * 2**20 % 5 < 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text))
            for lang, words in found.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {lang: Counter() for lang in sizes}
        for batch in batches:
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[lang][word] = n
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_counts(counts, order))], pa.binary())], ["model"])

    words = sample.where(~calibrates).select("text", "lang").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    most = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    words = words.withColumn("place", most).where(F.col("place") <= max_words).select("lang", "word", "n")
    m: Model = pickle.loads(words.coalesce(1).mapInArrow(make, "model binary").first()["model"])
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            h, n = scorer.texts([t.encode("utf-8", "replace") for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array(h.tolist(), pa.list_(pa.float64())), pa.array(n), batch.column(1), batch.column(2)], ["h", "n", "lang", "doc_id"])

    got = sample.where(calibrates).select("text", "lang", "doc_id").mapInArrow(measure, f"h array<double>, n double, lang string, doc_id {rows.schema['doc_id'].dataType.simpleString()}").orderBy("doc_id").toArrow()
    shared.destroy()
    return calibrate(m, np.array(got["h"].to_pylist(), float).reshape(-1, len(m.langs)), got["n"].to_numpy(), got["lang"].to_pylist())


def judged(m: Model, scorer: Scorer, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, cross-entropy in it and rejection of each text."""
    h, n = scorer.texts(texts)
    has, p = n > 0, _softmax(-h * m.sharpness).max(1)
    lang = np.where(has, np.array(m.langs, object)[h.argmin(1)], "und")
    return lang, np.where(has, p, 0.0), np.where(has, h.min(1), 0.0), ~has | too_strange(m, h, n)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", group: int = 1000) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, cross_entropy, rejected.

    ``und`` (score 0, rejected) if a text is null or has no letter. Ties of languages go to the first name.
    Whole texts are scored, however long. Rows may repeat and ids be null (held_out is then null); an empty
    table gives an empty result; further columns, whatever their names, are ignored. No shuffle.
    """
    ship(docs.sparkSession)
    m = docs.sparkSession.sparkContext.broadcast(model)
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(m.value)
        for whole in batches:
            for at in range(0, whole.num_rows, group):
                batch = whole.slice(at, group)
                lang, score, low, rejected = judged(m.value, scorer, batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, rejected boolean")
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def keep_accepted(docs: DataFrame, model: Model, text_col: str = "text", group: int = 1000) -> DataFrame:
    """The rows of ``docs`` that :func:`predict` would not reject, with their columns as they are, whatever their names."""
    ship(docs.sparkSession)
    m = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(m.value)
        for whole in batches:
            for at in range(0, whole.num_rows, group):
                batch = whole.slice(at, group)
                yield batch.filter(pa.array(~judged(m.value, scorer, batch.column(at_text).cast(pa.binary()).to_pylist())[3]))

    return spread(docs).mapInArrow(run, docs.schema)
