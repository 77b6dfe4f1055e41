"""Rule and registry files: read once at planning time and validated before any job starts."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, fields

from corpusq import config as C
from corpusq.noise_rules import NoiseRule

STRATEGIES = ("span", "sentence", "promo_block", "to_end")


def parse_noise_rules(text: str) -> list[NoiseRule]:
    """Noise rules of a TOML text with tables ``[[noise_rules]]``, in order.

    Unknown keys and strategies, patterns that do not compile, missing and repeated names are refused.
    """
    known, out = {f.name for f in fields(NoiseRule)}, []
    for row in tomllib.loads(text).get("noise_rules", []):
        if extra := set(row) - known - {"category"}:
            raise ValueError(f"unknown keys: {sorted(extra)}")
        rule = NoiseRule(**({"strategy": "span"} | {k: v for k, v in row.items() if k != "category"}))
        if rule.strategy not in STRATEGIES:
            raise ValueError(f"{rule.name}: unknown strategy {rule.strategy}")
        try:
            re.compile(rule.pattern)
        except re.error as e:
            raise ValueError(f"{rule.name}: {e}") from e
        out.append(rule)
    if len({r.name for r in out}) < len(out):
        raise ValueError("names repeat")
    return out


def parse_registry(text: str) -> dict[str, tuple[str, bool, list[str], list[str]]]:
    """ticker -> (name, indexed, aliases, products) of a JSON text {ticker: {name, aliases, products, indexed}}.

    Tickers must be upper case, names present, and an alias must not belong to two companies.
    """
    out: dict[str, tuple[str, bool, list[str], list[str]]] = {}
    owner: dict[str, str] = {}
    for ticker, row in json.loads(text).items():
        if ticker != ticker.upper() or not isinstance(row, dict) or not row.get("name"):
            raise ValueError(f"{ticker}: needs an upper-case ticker and a name")
        aliases, products = row.get("aliases", [row["name"]]), row.get("products", [])
        if not all(isinstance(x, str) and x.strip() for x in [*aliases, *products]):
            raise ValueError(f"{ticker}: blank alias or product")
        for a in aliases:
            if owner.setdefault(a.upper(), ticker) != ticker:
                raise ValueError(f"alias {a} belongs to {owner[a.upper()]} and {ticker}")
        out[ticker] = (row["name"], bool(row.get("indexed", False)), aliases, products)
    return out


@dataclass(frozen=True)
class Settings:
    """Limits and thresholds; defaults are the fixed values."""

    top_k: int = C.TOP_K
    prefetch_k: int = C.PREFETCH_K
    full_coverage: int = C.FULL_COVERAGE
    chunk_tokens: int = C.CHUNK_TOKENS
    chunk_overlap: int = C.CHUNK_OVERLAP
    min_words: int = C.MIN_WORDS
    title_jaccard: float = C.TITLE_JACCARD
    body_jaccard: float = C.BODY_JACCARD

    def __post_init__(self) -> None:
        if min(self.top_k, self.prefetch_k, self.full_coverage, self.chunk_tokens, self.min_words) < 1 or self.chunk_overlap < 0:
            raise ValueError("limits must be positive")
        if self.prefetch_k < self.top_k:
            raise ValueError("prefetch_k must be top_k at least")
        if not (0 < self.title_jaccard <= 1 and 0 < self.body_jaccard <= 1):
            raise ValueError("similarities lie in (0, 1]")


def settings(env: dict[str, str] | None = None, prefix: str = "CORPUSQ_") -> Settings:
    """Settings from environment variables (CORPUSQ_TOP_K and so on) over the defaults."""
    env = dict(os.environ) if env is None else env
    return Settings(**{f.name: type(f.default)(env[key]) for f in fields(Settings) if (key := prefix + f.name.upper()) in env})
