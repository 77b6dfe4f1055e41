"""Lexical retrieval packing: windows of related documents, found in a sharded BM25 index.

Documents that share words are routed to the same shard: the table is ordered by two weighted minimum hashes of
each document's words (long words weigh more), and shards are runs of that order. In a shard an inverted index over
token ids, with document frequencies and the mean length of the whole table, returns the unused neighbours of a
seed document, which fill the seed's window.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusq.functions.partitions import spread
from corpusq.llm.common import checkpoint, mix64, ship
from corpusq.llm.sp_fst import _spans

#: Runs of letters, or of what stands behind them, whose ids a worker remembers (about 50 bytes each); from a full memory
#: the half met most often stays.
MEMORY = 250_000
#: Bytes up to which a chunk is remembered and handled together with others.
SHORT = 40
PARTS = regex.compile(r"\p{L}+|\P{L}+")
#: What keeps a chunk whole: apostrophes, special marks, other scripts (from U+0240 on) and a letter that grows in lower case.
ODD = re.compile(rb"['<\xc9-\xff]|\xc4\xb0")
#: The same for Arrow, over characters.
ODD_TEXT = r"['<\x{240}-\x{10FFFF}]|\x{130}"
#: What can stand behind letters as a run of its own: ASCII without letters, white space, controls, apostrophe and <.
BEHIND = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalpha() and c not in "'<")
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: The byte alphabet of byte-level BPE: bytes of visible characters stand for themselves, the others follow from 256 on.
BYTES = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _SHOWN)}
#: What one byte does to a CRC-32.
CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    CRC = np.where(CRC & 1, CRC >> np.uint32(1) ^ np.uint32(0xEDB88320), CRC >> np.uint32(1))
K1, B = 1.2, 0.75


class Ids:
    """Token ids of texts by a tokenizers file, from the ids of white-space-separated chunks where these add up."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_padding()
        self.tok.no_truncation()
        probe = "Hello  wörld\n\tfoo's x\x0b\x0cbar <b>\r\n ñ 12"
        one = lambda s: self.tok.encode(s, add_special_tokens=False).ids
        self.by_chunk = one(probe) == [i for c in probe.encode().split() for i in one(c.decode())] and one(" a") == one("a")
        special = [(i, t.content) for i, t in self.tok.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.normalized)]
        self.mark = next(((i, c) for i, c in special if one(f"a{c}b") == [*one("a"), i, *one("b")]), None)
        probe = "Éa12.foo,Bar(bAz)!!x-y_z::9ß"
        #: Whether runs of letters and what stands between them have ids of their own, in lower case.
        self.by_part = one(probe) == [i for p in PARTS.findall(probe.lower()) for i in one(p)]
        self.model = self.tok.model
        words = ["a", "hello", "thhaning", "éèñß", "überkeit", "ō"]
        #: Whether the model alone gives a run of letters the same ids, when its bytes are spelled in the byte alphabet.
        self.by_model = all(self.word(w) == np.array(one(w), "<u4").tobytes() for w in words)
        self.part: dict[bytes, bytes] = {}
        #: Remembered runs, in how many calls each was met, and their ids.
        self.runs, self.met, self.pool = pa.array([], pa.string()), np.zeros(0, np.int64), Pool.of([])

    def word(self, word: str) -> bytes:
        """Ids of a lower-case run of letters, from the tokenizer's model without its other steps."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTES)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def fresh(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, as little-endian 32-bit integers; most in one call, apart by a special token."""
        made: dict[str, bytes] = {}
        plain = [t for t in texts if self.mark and "<" not in t]
        if plain:
            i, mark = self.mark
            ids = np.array(self.tok.encode_batch_fast([mark.join(plain)], add_special_tokens=False)[0].ids, "<u4")
            raw, cuts = ids.tobytes(), np.append(np.nonzero(ids == i)[0], len(ids)) * 4
            at = 0
            for t, cut in zip(plain, cuts.tolist(), strict=True):
                made[t] = raw[at:cut]
                at = cut + 4
        rest = [t for t in texts if t not in made]
        for t, e in zip(rest, self.tok.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            made[t] = np.array(e.ids, "<u4").tobytes()
        return [made[t] for t in texts]

    def rows(self, runs: pa.StringArray) -> np.ndarray:
        """The row in memory of each run of lower-case letters or of other characters; new runs are spelled."""
        if len(self.runs) > MEMORY:
            keep = np.sort(np.argsort(self.met, kind="stable")[-(MEMORY // 2) :])
            self.runs, self.met, self.pool = self.runs.take(pa.array(keep)), self.met[keep] // 2, self.pool.take(keep)
        coded = runs.dictionary_encode()
        row = pc.index_in(coded.dictionary, value_set=self.runs)
        fresh = coded.dictionary.filter(row.is_null())
        row = row.fill_null(-1).to_numpy().copy()
        if len(fresh):
            row[row < 0] = len(self.runs) + np.arange(len(fresh))
            new = fresh.to_pylist()
            others = [r for r in new if not r.isalpha()]
            made = dict(zip(others, self.fresh(others), strict=True))
            self.pool = self.pool.plus(Pool.of([made[r] if r in made else self.word(r) for r in new]))
            self.runs, self.met = pa.concat_arrays([self.runs, fresh]), np.append(self.met, np.zeros(len(new), np.int64))
        self.met[row] += 1
        return row[coded.indices.to_numpy()]

    def spell(self, words: pa.StringArray) -> Pool:
        """Ids of each chunk: letters and what stands behind them by their rows in memory, all at once; others one by one."""
        plain = np.zeros(len(words), bool)
        first, size = np.zeros((2, len(words), 2), np.int64)
        if self.by_part and self.by_model:
            core = pc.ascii_rtrim(words, BEHIND)
            letters = pc.and_(pc.utf8_is_alpha(core), pc.invert(pc.match_substring_regex(core, ODD_TEXT)))
            data, at, n = raw_bytes(words)
            k = n - pc.binary_length(core).to_numpy()
            plain = (letters.to_numpy(zero_copy_only=False) | (k == n)) & (n <= SHORT)
            start, k = (at + n - k)[plain], k[plain]
            behind = pa.StringArray.from_buffers(len(k), pa.py_buffer(np.append(0, np.cumsum(k)).astype(np.int32)), pa.py_buffer(data[_spans(start, k)]))
            row = self.rows(pa.concat_arrays([pc.utf8_lower(core.filter(pa.array(plain))), behind])).reshape(2, -1).T
            first[plain], size[plain] = self.pool.first[row], self.pool.size[row]
        pool = self.pool
        if not plain.all():
            rest = Pool.of(self.chunks(words.filter(pa.array(~plain)).cast(pa.binary()).to_pylist()))
            first[~plain, 0], size[~plain, 0] = rest.first + len(pool.ids), rest.size
            pool = pool.plus(rest)
        n = size.sum(axis=1)
        return Pool(pool.ids[_spans(first.ravel(), size.ravel())], np.cumsum(n) - n, n)

    def chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of each chunk, from those of its parts."""
        if len(self.part) > MEMORY:
            self.part = {}
        part, other, out, whole = self.part, self._part, [], []
        for c in chunks:
            if self.by_part and not ODD.search(c):
                out.append(b"".join([part.get(k := p.encode()) or other(k) for p in PARTS.findall(c.decode().lower())]))
            else:
                whole.append(len(out))
                out.append(b"")
        for at, ids in zip(whole, self.fresh([chunks[i].decode() for i in whole]), strict=True):
            out[at] = ids
        return out

    def _part(self, part: bytes) -> bytes:
        """Ids of a run of lower-case letters, or of what stands between two; remembers those of a short one."""
        text = part.decode()
        ids = self.word(text) if self.by_model and text.isalpha() else self.fresh([text])[0]
        if len(part) <= SHORT:
            self.part[part] = ids
        return ids

    def texts(self, texts: pa.StringArray, words: pa.StringArray, flat: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        """Ids of each text; words, flat and ends are what :func:`cut_words` gives for the texts."""
        if not self.by_chunk:
            return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        if not len(flat):
            return [np.zeros(0, "<u4")] * len(texts)
        pool = self.spell(words)
        size = pool.size[flat]
        ids, cum = pool.ids[_spans(pool.first[flat], size)], np.append(0, np.cumsum(size))
        return [ids[cum[a] : cum[b]] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Pool(NamedTuple):
    """Runs of ids: all ids, and where each run starts among them and how many it has."""

    ids: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @staticmethod
    def of(runs: list[bytes]) -> Pool:
        size = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        return Pool(np.frombuffer(b"".join(runs), "<u4"), np.cumsum(size) - size, size)

    def plus(self, more: Pool) -> Pool:
        return Pool(np.append(self.ids, more.ids), np.append(self.first, more.first + len(self.ids)), np.append(self.size, more.size))

    def take(self, rows: np.ndarray) -> Pool:
        size = self.size[rows]
        return Pool(self.ids[_spans(self.first[rows], size)], np.cumsum(size) - size, size)


def raw_bytes(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of the words, and where each word starts among them and how many it has."""
    if not len(words):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    return np.frombuffer(words.buffers()[2] or b"", np.uint8), at[:-1], np.diff(at)


def cut_words(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Distinct words between ASCII white space, each word's row among them, and where each text's words start (and the end)."""
    cut = pc.ascii_split_whitespace(texts)
    words, number = cut.flatten(), pc.list_value_length(cut).fill_null(0).to_numpy()
    full = pc.greater(pc.binary_length(words), 0)  # white space at an end of a text leaves an empty word
    before = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))
    coded = words.filter(full).dictionary_encode()
    return coded.dictionary.cast(pa.string()), coded.indices.to_numpy(), before[np.append(0, np.cumsum(number))]


def crc32s(words: pa.StringArray) -> np.ndarray:
    """zlib.crc32 of each word, byte by byte for all words at once; long words by themselves."""
    data, first, size = raw_bytes(words)
    out, long = np.full(len(words), 0xFFFFFFFF, np.uint32), np.nonzero(size > SHORT)[0]
    at, j = np.nonzero(size <= SHORT)[0], 0
    while len(at := at[size[at] > j]):
        out[at] = CRC[(out[at] ^ data[first[at] + j]) & np.uint32(255)] ^ (out[at] >> np.uint32(8))
        j += 1
    out = ~out
    out[long] = [zlib.crc32(data[a : a + n]) for a, n in zip(first[long].tolist(), size[long].tolist(), strict=True)]
    return out


def routes(words: pa.StringArray, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers a text. Each is the name of the word of the least hash, drawn at a rate of its squared length.

    Two texts agree in a number with the probability of their words' weighted overlap. Texts without words have zeros.
    """
    size = raw_bytes(words)[2]
    code = crc32s(words).astype(np.uint64) << np.uint64(8) | np.minimum(size, 255).astype(np.uint64)
    rate = np.minimum(size, 20) ** 2.0
    out, full = np.zeros((len(ends) - 1, 2), np.int64), np.nonzero(np.diff(ends))[0]
    for k in range(2):
        h = mix64(code + np.uint64(k * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        wait = -np.log(((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / rate
        if len(full):
            out[full, k] = mix64(np.minimum.reduceat(wait[flat], ends[full]).view(np.uint64)).view(np.int64)
    return out


_IDS: dict[str, Ids] = {}


def token_ids(path: str) -> Ids:
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def term_counts(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and number of every term of every document, in order."""
    flat = np.concatenate(docs)
    bits = 16 if len(docs) <= 1 << 16 and flat.dtype == np.uint16 else 32
    owner = np.repeat(np.arange(len(docs), dtype=np.uint32 if bits == 16 else np.int64), [len(d) for d in docs])
    both = np.sort((owner << bits) | flat)
    first = np.nonzero(np.append(True, both[1:] != both[:-1]))[0] if len(both) else np.zeros(0, np.int64)
    both, tf = both[first].astype(np.int64), np.diff(np.append(first, len(both))).astype(float)
    return both >> bits, both & ((1 << bits) - 1), tf


class Index:
    """BM25 postings of one shard's documents, term by term. ``idf`` by token id and ``mean`` length are the table's."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        n, length = len(docs), np.array([len(d) for d in docs], np.int64)
        owner, term, tf = term_counts(docs)
        w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[owner] / mean))
        kinds, term, df = np.unique(term, return_inverse=True, return_counts=True)
        order = np.argsort(term.astype(np.uint16) if len(kinds) < 1 << 16 else term, kind="stable")
        self.n, self.doc, self.w = n, owner[order], w[order]
        self.first, self.df = np.cumsum(df) - df, df
        self.term, self.start = term, np.searchsorted(owner, np.arange(n + 1))
        self.live = n

    def forget(self, used: np.ndarray) -> None:
        """Drop the postings of used documents, once they are a quarter of those that are left."""
        live = self.n - int(used.sum())
        if live <= 0.75 * self.live:
            self.live, keep = live, ~used[self.doc]
            before = np.append(0, np.cumsum(keep))
            self.first, self.df = before[self.first], before[self.first + self.df] - before[self.first]
            self.doc, self.w = self.doc[keep], self.w[keep]

    def neighbours(self, seed: int, used: np.ndarray) -> np.ndarray:
        """All unused documents that share a term with the seed, by falling score, ties by position."""
        t = self.term[self.start[seed] : self.start[seed + 1]]
        self.forget(used)
        t = t[self.df[t] > 0]
        if not len(t):
            return t
        at = _spans(self.first[t], self.df[t])
        score = np.bincount(self.doc[at], self.w[at], self.n)
        score[used] = 0
        score[seed] = 0
        hit = np.nonzero(score)[0]
        return hit[np.lexsort((hit, -score[hit]))]


def bm25_idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def pack_shard(docs: list[np.ndarray], window: int, idf: np.ndarray, mean: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one shard, without padding. No document is longer than the window.

    The first unused document is the seed; its neighbours follow by score as long as they fit, and the best one left
    is cut to fill the window (its rest becomes the next seed). A window for which the neighbours do not suffice goes on
    with the next unused documents. What remains at the end is shorter than a window and becomes sequences
    whose lengths are powers of two, the longest first.
    """
    pieces, seq = [], 0
    start, left = np.zeros(len(docs), np.int64), np.array([len(d) for d in docs], np.int64)
    used = left == 0
    index = Index(docs, idf, mean) if len(docs) else None
    cursor, seed = 0, -1
    last: list[tuple[int, int, int]] = []
    while True:
        if seed < 0:
            while cursor < len(docs) and used[cursor]:
                cursor += 1
            if cursor == len(docs):
                break
            seed = cursor
        used[seed] = True
        chosen, room = [(seed, int(start[seed]), int(left[seed]))], window - int(left[seed])
        if room:
            near = index.neighbours(seed, used)
            size, at, taken = left[near], 0, np.zeros(len(near), bool)
            while room:  # those that fit now, as many in a row as fit together
                fit = np.nonzero(size[at:] <= room)[0] + at
                if not len(fit):
                    break
                reach = np.cumsum(size[fit])
                k = int(np.searchsorted(reach, room, side="right"))
                taken[fit[:k]] = True
                room, at = room - int(reach[k - 1]), int(fit[k - 1]) + 1
            chosen += zip(near[taken].tolist(), start[near[taken]].tolist(), size[taken].tolist(), strict=True)
            used[near[taken]] = True
            skipped = np.nonzero(~taken)[0]
            if room and len(skipped):  # the best one that did not fit is longer than the room: cut it
                seed = int(near[skipped[0]])
                chosen.append((seed, int(start[seed]), room))
                start[seed] += room
                left[seed] -= room
                room = 0
            else:
                seed = -1
        else:
            seed = -1
        while room:  # without neighbours take documents in order
            while cursor < len(docs) and used[cursor]:
                cursor += 1
            if cursor == len(docs):
                break
            take = min(room, int(left[cursor]))
            chosen.append((cursor, int(start[cursor]), take))
            start[cursor] += take
            left[cursor] -= take
            room -= take
            if left[cursor]:
                seed = cursor
            else:
                used[cursor] = True
        if room:
            last = chosen
            break
        at = 0
        for d, s, n in chosen:
            pieces.append((d, s, n, seq, at))
            at += n
        seq += 1
    at, cap = 0, 0
    total = sum(n for _, _, n in last)
    for d, s, n in last:
        while n:
            if at == cap:
                cap, at = 1 << (total.bit_length() - 1), 0
                total -= cap
                seq += 1
            take = min(n, cap - at)
            pieces.append((d, s, take, seq - 1, at))
            s, n, at = s + take, n - take, at + take
    return pieces


def grouped(batches: Iterator[pa.RecordBatch], rows: int, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``rows`` rows or ``size`` bytes, whichever is less, as words shared by a batch cost once."""
    held: list[pa.RecordBatch] = []
    step, n = max(1, min(50, rows)), 0
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            part = whole.slice(at, step)
            if held and (sum(b.num_rows for b in held) + part.num_rows > rows or n + part.nbytes > size):
                yield pa.concat_batches(held)
                held, n = [], 0
            held.append(part)
            n += part.nbytes
    if held:
        yield pa.concat_batches(held)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = 2000, shard_tokens: int = 1_000_000, group: int = 1000) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the tokenizers file without added special tokens, then ``end_id`` (unless
    None). Every id lies in one piece; sequences are full or have a power of two as length, so none is padded.
    Whole windows of a long document, however long it is, are sequences of their own; its rest is packed like a
    short document. Null text counts as empty (the end id alone; without one, such documents have no piece). Rows that
    repeat an id or a text are packed each for itself; ids may be null or of any type. An empty table gives an
    empty result; further columns, whatever their names, are ignored.

    Token ids are checkpointed (two bytes each if they fit). One narrow aggregation, combined in each task, counts the
    document frequencies (as many rows as the vocabulary has). Then one range partitioning by the routes, with a
    hash of the row behind them, moves the rests: partitions are equal in size even if one text or route is a third
    of the table. A task cuts its sorted rows into shards of at most ``shard_docs`` documents and about ``shard_tokens``
    ids, so its memory does not grow with the table. Ties are broken by that hash and the id's text, so a retried task packs alike.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = spread(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = token_ids(tokenizer_path)
        for batch in grouped(batches, group):
            texts = batch.column(1)
            cut = cut_words(texts)
            ids = t.texts(texts, *cut)
            if end_id is not None:
                ids = [np.append(x, np.uint32(end_id)) for x in ids]
            crc = [[zlib.crc32(x[i : i + window].astype("<u4").tobytes()) for i in range(0, len(x) - window + 1, window)] for x in ids]
            rest = [x[len(x) // window * window :] for x in ids]
            wide = [len(x) > 0 and int(x.max()) > 0xFFFF for x in rest]
            raw = [x.astype("<u4" if w else "<u2").tobytes() for x, w in zip(rest, wide, strict=True)]
            route = routes(*cut)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.list_(pa.int64())), pa.array(wide), pa.array(raw, pa.binary()), pa.array(route[:, 0]), pa.array(route[:, 1])], ["doc_id", "n", "crc", "wide", "ids", "r1", "r2"])

    tokens = checkpoint(rows.mapInArrow(tokenise, f"doc_id {kind}, n long, crc array<long>, wide boolean, ids binary, r1 long, r2 long"))
    rests = tokens.where(F.length("ids") > 0)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(1 << 16, np.int64)
        for batch in batches:
            ids = [np.frombuffer(x, "<u4" if w else "<u2") for w, x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            seen = term_counts(ids)[1]
            if len(df) <= seen.max(initial=0):
                df = np.append(df, np.zeros(int(seen.max()) + 1 - len(df), np.int64))
            df += np.bincount(seen, minlength=len(df))
        term = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df[term])], ["term", "df"])

    found = rests.select("wide", "ids").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    size = rests.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.col("n") % window), F.lit(0)).alias("ids")).first()
    df = np.zeros(max(found["term"].to_pylist(), default=0) + 1)
    df[found["term"].to_numpy()] = found["df"].to_numpy()
    shared = spark.sparkContext.broadcast(bm25_idf(df, size["rows"]))
    mean = max(1.0, size["ids"] / max(1, size["rows"]))

    def packed(kept: list[pa.RecordBatch], part: int, seq: int) -> tuple[pa.RecordBatch, int]:
        table = pa.Table.from_batches(kept).combine_chunks()
        ids = [np.frombuffer(x, "<u4" if w else "<u2") for x, w in zip(table["ids"].to_pylist(), table["wide"].to_pylist(), strict=True)]
        got = np.array(pack_shard(ids, window, shared.value, mean), np.int64).reshape(-1, 5)
        crc = [zlib.crc32(ids[d][s : s + k].astype("<u4").tobytes()) for d, s, k, _, _ in got.tolist()]
        size = table["n"].to_numpy()
        before = size // window * window
        out = [table["doc_id"].combine_chunks().take(pa.array(got[:, 0])), pa.array(before[got[:, 0]] + got[:, 1]), pa.array(got[:, 2]), pa.array(crc, pa.int64()), pa.array(size[got[:, 0]]), pa.array((part << 36) + seq + got[:, 3]), pa.array(got[:, 4])]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]), seq + int(got[:, 3].max(initial=-1)) + 1

    def pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, ids = TaskContext.get().partitionId(), 0, [], 0
        for whole in batches:
            size = pc.binary_length(whole.column(3)).to_numpy() // 2
            for i in range(0, whole.num_rows, 100):
                held.append(whole.slice(i, 100))
                ids += int(size[i : i + 100].sum())
                if sum(map(len, held)) + 100 > shard_docs or ids >= shard_tokens:
                    made, seq = packed(held, part, seq)
                    yield made
                    held, ids = [], 0
        if held:
            yield packed(held, part, seq)[0]

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    tie = F.xxhash64(F.col("doc_id").cast("string"), "ids")
    parts = max(1, -(-size["ids"] // (4 * shard_tokens)), min(spark.sparkContext.defaultParallelism, size["rows"] // shard_docs))
    by = ["r1", "r2", "tie"]
    dealt = rests.select("doc_id", "n", "wide", "ids", "r1", "r2", tie.alias("tie")).repartitionByRange(int(parts), *by).sortWithinPartitions(*by, F.col("doc_id").cast("string"))
    short = dealt.select("doc_id", "n", "wide", "ids").mapInArrow(pack_rows, schema)
    full = tokens.where(F.size("crc") > 0).select("doc_id", F.posexplode("crc").alias("i", "ids_crc32"), "n")
    number = F.lit(1 << 62) + F.monotonically_increasing_id()
    return full.select("doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"), "ids_crc32", F.col("n").alias("doc_tokens"), number.alias("sequence_id"), F.lit(0).cast("long").alias("offset")).unionAll(short)
