"""Vocabulary of a SentencePiece model and the cut of texts into pre-tokens that no piece crosses."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np

from corpusq.llm.common import Words

SPACE = "▁"


@dataclass
class Pieces:
    """text[i] and score[i] of the pieces that may match text; byte_ids[b] of the byte pieces."""

    texts: list[str]
    scores: list[float]
    usable: list[bool]
    byte_ids: list[int]
    bpe: bool = True
    ids: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.ids = {t: i for i, (t, u) in enumerate(zip(self.texts, self.usable, strict=True)) if u}
        if any(SPACE in t.lstrip(SPACE) for t in self.ids):
            raise ValueError("a piece holds a space after another character; texts cannot be cut at spaces")
        self.longest = max(map(len, self.ids), default=1)
        #: Whether a line feed always stands alone, so that texts can be cut there too.
        self.cut_lines = not any("\n" in t and len(t) > 1 for t in self.ids)


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or varint()
        yield tag >> 3, raw[at : at + size]
        at += size


def model_type(path: str) -> int:
    """The file's kind of model: 1 unigram, 2 BPE (trainer settings are field 2, their kind of model is field 3)."""
    with open(path, "rb") as f:
        settings = next((v for k, v in _fields(f.read()) if k == 2), b"")
    return next((v for k, v in _fields(settings) if k == 3), 1)


def load(path: str) -> Pieces:
    """Read a .model file. Supported: BPE or unigram with byte fallback, dummy prefix, identity normaliser."""
    import sentencepiece

    kind = model_type(path)
    if kind not in (1, 2):
        raise ValueError("only unigram and BPE models are supported")

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    if sp.normalize("ﬁ  é ") != "▁ﬁ▁▁é▁":
        raise ValueError("only the identity normaliser with a dummy prefix is supported")
    n = range(sp.get_piece_size())
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    usable = [not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) for i in n]
    return Pieces([sp.id_to_piece(i) for i in n], [sp.get_score(i) for i in n], usable, byte_ids, bpe=kind == 2)


_RUNS = re.compile(rb"\n[^ \n]*| +[^ \n]*")
_RUNS_LINES_KEPT = re.compile(rb" +[^ ]*")


def pretokens(text: bytes, cut_lines: bool = True) -> Sequence[bytes]:
    """Keys of the pre-tokens of a text that is not empty, in order.

    A key without a leading space or line feed stands for one space and itself (the dummy prefix counts as a
    space); other keys stand for themselves.
    """
    if b"\xe2\x96\x81" in text:
        text = text.replace(b"\xe2\x96\x81", b" ")
    parts = (text.replace(b"\n", b" \n") if cut_lines else text).split(b" ")
    if b"" not in parts and not (cut_lines and text[:1] == b"\n") and (cut_lines or b"\n" not in text):
        return parts
    runs = (_RUNS if cut_lines else _RUNS_LINES_KEPT).findall(b" " + text)
    return [r[1:] if r[:1] == b" " and r[1:2] not in (b" ", b"", b"\n") else r for r in runs]


def spelled(key: bytes) -> str:
    """The characters a key stands for, before normalisation."""
    s = key.decode("utf-8", "replace")
    return s if s[:1] in (" ", "\n") else " " + s


def batch_keys(texts: list[bytes | None], cut_lines: bool) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct keys of a batch, each pre-token's row among them, and where each text's pre-tokens start (and the end)."""
    words, flat, ends = Words(), [], np.zeros(len(texts) + 1, np.int64)
    for i, t in enumerate(texts):
        if t:
            flat.extend(map(words.__getitem__, pretokens(t, cut_lines)))
        ends[i + 1] = len(flat)
    return list(words), np.array(flat, np.int64), ends
