"""Token counts by rank-synchronous merging.

Pre-tokens are held as one ragged numpy array. In each round every sequence finds its adjacent pair of the
lowest rank and all sequences merge theirs at once; a sequence without a pair leaves. Where no pair with the merged
piece ranks before it, all places of the pair in a sequence are merged in one round, which equals merging them one by
one from the left; for the other pieces a round merges the leftmost place. Sequences left with pairs of the very last
rank only (where a model has many equal ones, as for runs of spaces) are finished from the left in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.functions.partitions import spread
from corpusq.llm.common import ship
from corpusq.llm.pieces import SPACE, Pieces, batch_keys, load, spelled

#: Entries of a worker's memory of counted pre-tokens (of up to 64 bytes); a full one starts anew (results do not depend on it).
MEMORY = 400_000
NONE = np.iinfo(np.int32).max


class Merges:
    """Ranks and results of pairs, by a sorted array of pair keys."""

    def __init__(self, pieces: Pieces):
        if not pieces.bpe:
            raise ValueError("merging by rank needs a BPE model")
        self.pieces, self.base = pieces, len(pieces.texts) + 8
        order = sorted({s for s, u in zip(pieces.scores, pieces.usable, strict=True) if u}, reverse=True)
        rank = {s: r for r, s in enumerate(order)}
        rows, inside = [], set()
        for text, i in pieces.ids.items():
            for cut in range(1, len(text)):
                a, b = pieces.ids.get(text[:cut]), pieces.ids.get(text[cut:])
                x, y = pieces.ids.get(text[cut - 1]), pieces.ids.get(text[cut])
                if x is not None and y is not None:
                    inside.add(x * self.base + y)
                if a is not None and b is not None:
                    rows.append((a * self.base + b, rank[pieces.scores[i]], i))
        table = np.array(sorted(rows), np.int64).reshape(-1, 3)
        self.keys, self.ranks, self.results = np.append(table[:, 0], np.iinfo(np.int64).max), np.append(table[:, 1], NONE), np.append(table[:, 2], 0)
        own = np.array([rank.get(x, -1) for x in pieces.scores])
        earliest = np.full(len(own), NONE, np.int64)
        for half in (table[:, 0] // self.base, table[:, 0] % self.base):
            np.minimum.at(earliest, half, table[:, 1])
        #: Whether all places of a pair that makes the piece can be merged in one round.
        self.at_once = (earliest > own) & (np.bincount(np.maximum(own, 0), minlength=len(order) + 1)[np.maximum(own, 0)] == 1)
        self.last_rank = int(table[:, 1].max(initial=-1))
        self.last = dict(zip(table[table[:, 1] == self.last_rank, 0].tolist(), table[table[:, 1] == self.last_rank, 2].tolist(), strict=True))
        #: Pairs of characters that stand side by side in some piece; no merge crosses the border between two others.
        self.inside = np.append(np.array(sorted(inside), np.int64), np.iinfo(np.int64).max)
        self.known: dict[bytes, int] = {}

    def symbols(self, word: str) -> list[int]:
        """A piece id per character; a character of b bytes that is no piece becomes base - 8 + b."""
        get, n = self.pieces.ids.get, self.base - 8
        return [get(c, -1) if c in self.pieces.ids else n + len(c.encode("utf-8", "replace")) for c in word.replace(" ", SPACE)]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a * self.base + b
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.results[at]

    def finish(self, syms: list[int]) -> list[int]:
        """Merges of a sequence all of whose pairs have the last rank: always the leftmost place."""
        out: list[int] = []
        for s in syms:
            while out and (made := self.last.get(out[-1] * self.base + s)) is not None:
                out.pop()
                s = made
            out.append(s)
        return out

    def weight(self, syms: np.ndarray) -> np.ndarray:
        """Tokens a final symbol gives: its bytes if it is no piece, else 1."""
        return np.where(syms >= self.base - 8, syms - (self.base - 8), 1)

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each word. A word is one or several sequences: it falls apart where no piece crosses."""
        lists = [self.symbols(w) for w in words]
        sym = np.array([x for s in lists for x in s], np.int64)
        out = np.zeros(len(words), np.int64)
        if not len(sym):
            return out
        word = np.repeat(np.arange(len(words)), [len(s) for s in lists])
        pair = sym[:-1] * self.base + sym[1:]
        apart = (self.inside[np.searchsorted(self.inside, pair)] != pair) | (word[1:] != word[:-1])
        start = np.append(0, np.nonzero(apart)[0] + 1)
        owner, size = word[start], np.diff(np.append(start, len(sym)))
        rank, result = np.full(len(sym), NONE, np.int64), np.zeros(len(sym), np.int64)
        rank[:-1], result[:-1] = self.rank_of(sym[:-1], sym[1:])
        while len(owner):
            end = np.cumsum(size)
            start = end - size
            rank[end - 1] = NONE
            best = np.minimum.reduceat(rank, start)
            going = best < self.last_rank
            done = np.nonzero(best == NONE)[0]
            for i in np.nonzero(best == self.last_rank)[0].tolist():
                out[owner[i]] += self.weight(np.array(self.finish(sym[start[i] : end[i]].tolist()))).sum()
            if not going.all():
                np.add.at(out, owner[done], np.add.reduceat(self.weight(sym), start)[done])
                stay = np.repeat(going, size)
                sym, rank, result = sym[stay], rank[stay], result[stay]
                owner, size, best = owner[going], size[going], best[going]
                if not len(owner):
                    break
            at = np.nonzero(rank == np.repeat(best, size))[0]
            # Of places side by side every other one, from the left: the one before takes a place's first symbol.
            first = np.append(True, np.diff(at) > 1)
            nth = np.arange(len(at)) - np.nonzero(first)[0][np.cumsum(first) - 1]
            owned = np.repeat(np.arange(len(size)), size)[at]
            leftmost = np.append(True, owned[1:] != owned[:-1])
            at = at[leftmost | (self.at_once[result[at]] & (nth % 2 == 0))]
            sym[at] = result[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            size = size - np.bincount(np.repeat(np.arange(len(size)), size)[at], minlength=len(size))
            place = np.cumsum(stay)[at] - 1  # of the merged symbols among those that stay
            sym, rank, result = sym[stay], rank[stay], result[stay]
            # Only pairs with a merged symbol have changed.
            new = np.unique(np.concatenate([place, place[place > 0] - 1]))
            new = new[new + 1 < len(sym)]
            rank[new], result[new] = self.rank_of(sym[new], sym[new + 1])
        return out

    def counts(self, keys: list[bytes]) -> np.ndarray:
        """Tokens of each pre-token key; remembers them."""
        new = [k for k in keys if k not in self.known]
        if len(self.known) + len(new) > MEMORY:
            self.known = {}
            new = keys
        made = dict(zip(new, self.count([spelled(k) for k in new]).tolist(), strict=True)) if new else {}
        self.known.update((k, n) for k, n in made.items() if len(k) <= 64)
        return np.array([self.known[k] if k in self.known else made[k] for k in keys], np.int64)


_MERGES: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    """One table per worker."""
    if path not in _MERGES:
        _MERGES[path] = Merges(load(path))
    return _MERGES[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", group: int = 2000) -> DataFrame:
    """One row per input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts equal SentencePiece's for a BPE model with byte fallback, without begin and end tokens. Texts are
    counted whole, however long. Null text counts as empty (0 tokens); ids may be null and rows may repeat; an empty
    table gives an empty result; further columns, whatever their names, are ignored. No shuffle. ``model_path`` is read on each executor, from the installed
    tokenizer files. A worker handles ``group`` texts at once.
    """
    ship(docs.sparkSession)
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, group):
                batch = whole.slice(at, group)
                texts = batch.column(1).to_pylist()
                keys, flat, ends = batch_keys(texts, m.pieces.cut_lines)
                total = np.append(0, np.cumsum(m.counts(keys)[flat])) if len(flat) else np.zeros(1, np.int64)
                n = total[ends[1:]] - total[ends[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
