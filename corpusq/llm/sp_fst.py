"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled: the normaliser (a dummy prefix, then each character to itself and a space to the space
mark), the lexicon (a trie of the pieces that emits a piece where one ends, with byte fallback for a character that
is no piece) and the neighbours (which piece may follow which, at which weight). The first two are composed
once, so the trie reads texts as they are. Composed with an input they give a lattice: nodes are positions, arcs
are pieces. The output is the shortest path in the tropical semiring (min, +).

* Unigram models: an arc weighs the negated score of its piece; neighbours add nothing.
* BPE models: an arc weighs nothing after a piece it can stand next to, and infinity after any other. Pieces p
  and q can stand together when merging the text p + q by rank gives back p, q. The result of BPE is the only
  sequence all of whose neighbours can stand together: no merge ever crossed its borders, and the first merge
  to cross a border of another such sequence would also occur within the two pieces next to that border. So
  exactly one path has a finite weight, and so has the path to every position (the result for the text up to it).

So at every position one way in is enough to remember: with BPE no other is finite, and with unigram the way on
does not depend on it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.functions.partitions import spread
from corpusq.llm.common import ship
from corpusq.llm.pieces import SPACE, Pieces, batch_keys, load, spelled

#: Entries of a worker's memory of solved pre-tokens, and of parts; a full one starts anew.
MEMORY = 600_000
INF = float("inf")
#: Weight of byte fallback in a unigram model: more than any piece.
FALLBACK = 1e6


class Normaliser:
    """Character to character: the characters that become another one; all others stay."""

    def __init__(self) -> None:
        self.to, self.prefix = {" ": SPACE}, " "

    def sources(self, char: str) -> list[str]:
        """The characters read where ``char`` is written."""
        return [char, *(x for x, y in self.to.items() if y == char)]


class Lexicon:
    """The trie: ``step[state]`` gives the next state by character, ``emit[state]`` the piece that ends there (-1: none)."""

    def __init__(self, pieces: dict[str, int]) -> None:
        self.step: list[dict[str, int]] = [{}]
        self.emit = [-1]
        for text, piece in pieces.items():
            at = 0
            for char in text:
                at = self.step[at].setdefault(char, len(self.step))
                if at == len(self.step):
                    self.step.append({})
                    self.emit.append(-1)
            self.emit[at] = piece

    def after(self, normaliser: Normaliser) -> Lexicon:
        """The composition normaliser, then trie: an arc for a character is read from each of its sources."""
        out = Lexicon({})
        out.step = [{x: to for char, to in arcs.items() for x in normaliser.sources(char)} for arcs in self.step]
        out.emit = self.emit
        return out


class Neighbours:
    """Weight of piece q after piece p (-1: the start, or byte fallback), expanded where it is asked for."""

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.known = pieces, {}

    def merged(self, text: str) -> list[str]:
        """BPE of a short text by its definition: merge the best (then leftmost) pair while there is one."""
        s, ids, scores = list(text), self.pieces.ids, self.pieces.scores
        while len(s) > 1:
            best, at = -INF, -1
            for i in range(len(s) - 1):
                if (p := ids.get(s[i] + s[i + 1])) is not None and scores[p] > best:
                    best, at = scores[p], i
            if at < 0:
                break
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def weight(self, last: int, piece: int) -> float:
        key = (last + 1) << 24 | piece
        t = self.pieces.texts[piece]
        whole = [t] if last < 0 else [self.pieces.texts[last], t]
        ok = 0.0 if self.merged("".join(whole)) == whole else INF
        if len(self.known) >= 2_000_000:
            self.known.clear()
        self.known[key] = ok
        return ok


class Transducer:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        #: Bytes that a piece spells in decoding.
        self.spells = [t.replace(SPACE, " ").encode() if u else b"" for t, u in zip(pieces.texts, pieces.usable, strict=True)]
        for b, i in enumerate(pieces.byte_ids):
            self.spells[i] = bytes([b])
        self.normaliser = Normaliser()
        self.machine, self.neighbours = Lexicon(pieces.ids).after(self.normaliser), Neighbours(pieces)
        #: Characters that stand side by side in some piece. Between two others every path has a node, so lattices fall apart there.
        self.inside = {x + y for t in pieces.ids for i in range(len(t) - 1) for x in self.normaliser.sources(t[i]) for y in self.normaliser.sources(t[i + 1])}
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def path(self, text: str) -> list[int]:
        """Piece ids of the shortest path through the lattice of a text: each position's arcs are relaxed in order."""
        n, step, emit, near, bpe, scores = len(text), self.machine.step, self.machine.emit, self.neighbours.known, self.pieces.bpe, self.pieces.scores
        root, fallback = step[0], 0.0 if bpe else FALLBACK
        cost, last, back = [INF] * (n + 1), [-1] * (n + 1), [0] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            here, before = cost[i], (last[i] + 1) << 24
            state, j, single = root.get(text[i]), i + 1, False
            while state is not None:
                piece = emit[state]
                if piece >= 0:
                    single |= j == i + 1
                    if bpe:
                        weight = near.get(before | piece)
                        if weight is None:
                            weight = self.neighbours.weight(last[i], piece)
                    else:
                        weight = -scores[piece]
                    if here + weight < cost[j]:
                        cost[j], last[j], back[j] = here + weight, piece, i
                if j == n:
                    break
                state = step[state].get(text[j])
                j += 1
            if not single and here + fallback < cost[i + 1]:
                cost[i + 1], last[i + 1], back[i + 1] = here + fallback, -1, i
        out: list[int] = []
        while n:
            i = back[n]
            out.extend([last[n]] if last[n] >= 0 else [self.pieces.byte_ids[b] for b in reversed(text[i:n].encode("utf-8", "replace"))])
            n = i
        return out[::-1]

    def part(self, text: str) -> bytes:
        """Ids of a part that no piece crosses, as little-endian 32-bit integers; short parts are remembered."""
        ids = self.parts.get(text)
        if ids is None:
            ids = np.array(self.path(text), "<u4").tobytes()
            if len(text) < 64:
                if len(self.parts) >= MEMORY:
                    self.parts = {}
                self.parts[text] = ids
        return ids

    def spell(self, text: str) -> bytes:
        """Ids of a text that begins with the prefix or a character of its own, from those of its parts."""
        at, out, inside = 0, [], self.inside
        for i in range(1, len(text)):
            if text[i - 1 : i + 1] not in inside:
                out.append(self.part(text[at:i]))
                at = i
        out.append(self.part(text[at:]))
        return b"".join(out)

    def encode_keys(self, keys: list[bytes]) -> list[bytes]:
        """Ids of each pre-token key; remembers them."""
        if len(self.known) > MEMORY:
            self.known = {}
        known, out = self.known, []
        for k in keys:
            ids = known.get(k)
            if ids is None:
                ids = self.spell(spelled(k))
                if len(k) < 64:
                    known[k] = ids
            out.append(ids)
        return out

    def encode(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """Ids of each text. The lattice of a text falls apart where no piece crosses, so parts are solved once."""
        keys, flat, ends = batch_keys(texts, self.pieces.cut_lines)
        if not len(flat):
            return [np.zeros(0, "<u4")] * len(texts)
        parts = self.encode_keys(keys)
        size = np.array([len(p) for p in parts]) // 4
        pool, first = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size
        ids, cum = pool[_spans(first[flat], size[flat])], np.append(0, np.cumsum(size[flat]))
        return [ids[cum[a] : cum[b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The inverse machine: the pieces' bytes without the space of the dummy prefix.

        Ids that spell nothing (control and unknown pieces) vanish. Bytes that are no UTF-8 become U+FFFD.
        """
        out = b"".join(map(self.spells.__getitem__, ids.tolist()))
        out = out[1:] if out[:1] == b" " else out
        return out if out.isascii() else out.decode("utf-8", "replace").encode()


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (size[0] numbers), first[1], ..."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(first - (end - size), size)


_MACHINES: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    if path not in _MACHINES:
        _MACHINES[path] = Transducer(load(path))
    return _MACHINES[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", group: int = 1000) -> DataFrame:
    """One row per input row: doc_id, ids (array of int), decoded (the text decoded from them again).

    Null text counts as empty: no ids, decoded empty. Rows may repeat and ids be null; an empty table gives an
    empty result; further columns are ignored. No shuffle; a worker handles ``group`` texts at once.
    """
    return _run(docs, model_path, id_col, text_col, group, "ids array<int>, decoded string", lambda t, got: [pa.array([g.astype("i4") for g in got], pa.list_(pa.int32())), pa.array([t.decode(g).decode() for g in got], pa.string())])


def encode_digest(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", group: int = 1000) -> DataFrame:
    """Like :func:`encode`, with n_tokens, ids_crc32 (little-endian unsigned 32-bit ids) and round_trip (decoding gives the text) instead."""

    def digest(t: Transducer, got: list[np.ndarray], texts: list[bytes | None]) -> list[pa.Array]:
        same = [t.decode(g) == (x or b"").replace(SPACE.encode(), b" ") for g, x in zip(got, texts, strict=True)]
        return [pa.array([len(g) for g in got], pa.int64()), pa.array([zlib.crc32(g.tobytes()) for g in got], pa.int64()), pa.array(same, pa.bool_())]

    return _run(docs, model_path, id_col, text_col, group, "n_tokens long, ids_crc32 long, round_trip boolean", digest, True)


def _run(docs, model_path, id_col, text_col, group, columns, make, with_texts=False) -> DataFrame:
    ship(docs.sparkSession)
    rows = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text")))
    names = ["doc_id", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = machine(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, group):
                batch = whole.slice(at, group)
                texts = batch.column(1).to_pylist()
                got = t.encode(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(make(t, got, texts) if with_texts else make(t, got))], names)

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {columns}")
