"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits the features in turn; each step fits a tree of few leaves to the gradient over one
feature's bins and adds it to that feature's lookup table. Then the pairs with the largest gain on the residual
get tables of their own. A score is the sigmoid of an intercept and one table entry per feature and pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.functions.partitions import spread
from corpusq.llm.common import Words, fold, ship

FEATURES = ("log_bytes", "log_words", "word_length", "upper", "digit", "stop", "symbol", "wide", "blank", "lines", "distinct", "top_word", "repeats", "entropy", "pipes", "bangs", "long_words", "short_words")


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode())] = 1
    return out


_UPPER, _LOWER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("abcdefghijklmnopqrstuvwxyz"), _class("0123456789")
_STOP, _SYMBOL, _PIPE, _BANG = _class(".,;:"), _class("#$%&*<>{}[]=+~^_\\/@`"), _class("|"), _class("!?")
_BLANK, _LINE = _class(" \t\r\n"), _class("\n")
_WIDE = np.append(np.zeros(128), np.ones(128))
#: Bytes counted at once, so that a very long text needs no large array.
SLICE = 1 << 20


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row of FEATURES per text, from all of its bytes and words; zeros for null and empty texts."""
    hist = np.zeros((len(texts), 256))
    words, flat, ends = Words(), [], [0]
    for i, t in enumerate(texts):
        if t:
            a = np.frombuffer(t, np.uint8)
            for at in range(0, len(a), SLICE):
                hist[i] += np.bincount(a[at : at + SLICE], minlength=256)
            flat.extend(map(words.__getitem__, t.split()))
        ends.append(len(flat))
    idx, ends = np.array(flat, np.int64), np.array(ends)
    n_words = np.diff(ends)
    owner = np.repeat(np.arange(len(texts)), n_words)
    uniq, c = np.unique(owner * max(len(words), 1) + idx, return_counts=True)
    who = uniq // max(len(words), 1)
    distinct = np.bincount(who, minlength=len(texts))
    top = np.zeros(len(texts))
    np.maximum.at(top, who, c)
    same = (owner[1:] == owner[:-1]) & (idx[1:] == idx[:-1])
    repeats = np.bincount(owner[1:][same], minlength=len(texts))
    size = np.array([len(w) for w in words], np.int64)[idx] if len(idx) else idx
    count = lambda mask: np.bincount(owner[mask], minlength=len(texts))
    n, w = np.maximum(hist.sum(1), 1), np.maximum(n_words, 1)
    letters = np.maximum(hist @ (_UPPER + _LOWER + _WIDE), 1)
    p = hist / n[:, None]
    entropy = -(p * np.log(np.where(p > 0, p, 1))).sum(1)
    solid = hist.sum(1) - hist @ _BLANK
    out = np.stack([np.log1p(hist.sum(1)), np.log1p(n_words), solid / w, hist @ _UPPER / letters, hist @ _DIGIT / n, hist @ _STOP / w, hist @ _SYMBOL / n, hist @ _WIDE / n, hist @ _BLANK / n, hist @ _LINE / w, distinct / w, top / w, repeats / w, entropy, hist @ _PIPE / w, hist @ _BANG / w, count(size > 20) / w, count(size <= 3) / w], 1)
    out[hist.sum(1) == 0] = 0
    return out


@dataclass
class Gam:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    coarse: list[np.ndarray]  # bin -> coarse bin, by feature
    pair_tables: list[np.ndarray]
    intercept: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if self.edges else np.zeros((len(x), 0), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Vectorised additions of table entries, then the sigmoid."""
        b = self.bins(x)
        z = np.full(len(x), self.intercept)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for (i, j), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float, l2: float) -> tuple[np.ndarray, float]:
    """A tree of few leaves over ordered bins: the value per bin and the gain."""
    cg, ch = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    part = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + l2)
    cuts, gain = [0, len(g)], 0.0
    for _ in range(leaves - 1):
        best = (1e-9, -1)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            k = np.arange(a + 1, b)
            k = k[(ch[k] - ch[a] >= least) & (ch[b] - ch[k] >= least)]
            if len(k):
                d = part(a, k) + part(k, b) - part(a, b)
                i = int(np.argmax(d))
                best = max(best, (float(d[i]), int(k[i])))
        if best[1] < 0:
            break
        gain += best[0]
        cuts = sorted([*cuts, best[1]])
    value = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        value[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + l2)
    return value, gain


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float, l2: float) -> tuple[np.ndarray, float]:
    """A tree of depth two: the best cut of either axis, then the best cut of the other axis on each side."""
    best = (np.zeros_like(g), 0.0)
    whole = g.sum() ** 2 / (h.sum() + l2)
    for flip in (False, True):
        a, b = (g.T, h.T) if flip else (g, h)
        for k in range(1, a.shape[0]):
            value, gain = np.zeros_like(a), -whole
            for rows in (slice(0, k), slice(k, None)):
                v, more = _tree(a[rows].sum(0), b[rows].sum(0), 2, least, l2)
                gain += more + a[rows].sum() ** 2 / (b[rows].sum() + l2)
                value[rows] = v[None, :]
            if gain > best[1]:
                best = (value.T if flip else value, gain)
    return best


def fit_gam(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, pair_count: int = 6, pair_rounds: int = 30, rate: float = 0.15, leaves: int = 4, least: float = 2.0, l2: float = 1.0) -> Gam:
    n = x.shape[1]
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Gam([np.zeros(0)] * n, [np.zeros(1)] * n, [], [np.zeros(1, int)] * n, [], float(np.log(share / (1 - share))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(n)]
    m = Gam(edges, [np.zeros(len(e) + 1) for e in edges], [], [], [], float(np.log(y.mean() / (1 - y.mean()))))
    b = m.bins(x)
    z = np.full(len(y), m.intercept)
    for _ in range(rounds):
        for j in range(n):
            p = 1 / (1 + np.exp(-z))
            k = len(m.tables[j])
            value, gain = _tree(np.bincount(b[:, j], p - y, k), np.bincount(b[:, j], p * (1 - p), k), leaves, least, l2)
            if gain > 1e-6:
                m.tables[j] += rate * value
                z += rate * value[b[:, j]]
    m.coarse = [np.minimum(np.arange(len(t)) * 8 // len(t), 7) for t in m.tables]
    c = np.stack([m.coarse[j][b[:, j]] for j in range(n)], 1)
    p = 1 / (1 + np.exp(-z))
    grid = lambda i, j, w: np.bincount(c[:, i] * 8 + c[:, j], w, 64).reshape(8, 8)
    gains = [(_pair_tree(grid(i, j, p - y), grid(i, j, p * (1 - p)), least, l2)[1], i, j) for i in range(n) for j in range(i + 1, n)]
    m.pairs = [(i, j) for gain, i, j in sorted(gains, reverse=True)[:pair_count] if gain > 1e-6]
    m.pair_tables = [np.zeros((8, 8)) for _ in m.pairs]
    for _ in range(pair_rounds):
        for (i, j), table in zip(m.pairs, m.pair_tables, strict=True):
            p = 1 / (1 + np.exp(-z))
            value, _ = _pair_tree(grid(i, j, p - y), grid(i, j, p * (1 - p)), least, l2)
            table += rate * value
            z += rate * value[c[:, i], c[:, j]]
    return m


def _feature_rows(docs: DataFrame, id_col: str, text_col: str, extra: list[str], group: int = 500) -> DataFrame:
    rows = docs.select(F.col(text_col).cast("binary").alias("__text"), *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, group):
                batch = whole.slice(at, group)
                f = features(batch.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(f.tolist(), pa.list_(pa.float64()))], [*extra, "f"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in extra)
    return rows.mapInArrow(run, f"{kinds}, f array<double>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> Gam:
    """Fit on about ``max_rows`` labelled documents outside the held-out fold (by a hash of the id; all if fewer).

    So at most about max_rows ids are broadcast and as many rows of features reach the driver. Null labels do
    not count; a document with both labels counts twice.
    """
    ship(docs.sparkSession)
    ids = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("y")).where(F.col("y").isin(0.0, 1.0) & (fold("doc_id") != 0)).distinct()
    n = ids.count()
    u = F.xxhash64(F.lit("quality"), "doc_id").bitwiseAND(F.lit(2**40 - 1)) / F.lit(float(2**40))
    ids = ids.where(u < min(1.0, max_rows / max(n, 1)))
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id")
    got = _feature_rows(found, "doc_id", "text", ["doc_id", "y"]).toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable") if got.num_rows else np.zeros(0, int)
    x = np.array(got["f"].to_pylist(), float).reshape(-1, len(FEATURES))[order]
    return fit_gam(x, got["y"].to_numpy()[order])


def predict(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, group: int = 500) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 from ``threshold`` on).

    Null text counts as empty; empty texts are scored like all. Whole texts are read, however long. Rows may
    repeat and ids be null (held_out is then null); an empty table gives an empty result; further columns,
    whatever their names, are ignored. No shuffle.
    """
    ship(docs.sparkSession)
    m = docs.sparkSession.sparkContext.broadcast(model)
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, group):
                batch = whole.slice(at, group)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.value.score(features(batch.column(1).to_pylist())))], ["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Gam, text_col: str = "text", threshold: float = 0.3, group: int = 500) -> DataFrame:
    """The rows of ``docs`` that :func:`predict` would give 1, with their columns as they are, whatever their names."""
    ship(docs.sparkSession)
    m = docs.sparkSession.sparkContext.broadcast(model)
    at_text = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, group):
                batch = whole.slice(at, group)
                score = m.value.score(features(batch.column(at_text).cast(pa.binary()).to_pylist()))
                yield batch.filter(pa.array(score >= threshold))

    return spread(docs).mapInArrow(run, docs.schema)
