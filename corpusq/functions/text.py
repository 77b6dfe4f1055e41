"""Text functions as native column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusq import config as C

_NUM = r"(\d{1,3}(?:,\d{3})+|\d+)(?:\.(\d+))?"
_UNIT = r"(?:(\s*%|\s*(?i:per\s?cent)\b)|\s*((?i:trillion|billion|million|thousand|tn|bn|mn))\b|([TBMK])\b)"
# --- Fixed value: a figure with its unit. Groups: 1 whole digits, 2 decimals, 3-5 own unit, 6-8 the unit of the other end of a range. ---
QUANTITY = rf"(?U)(?<![\w.]){_NUM}{_UNIT}?(?:(?<!%)(?=\s*(?:-|to)\s*(?<![\w.])(?:\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.\d+)?{_UNIT}))?"


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often (or in whatever lambda) the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def fold_punctuation(text: Column) -> Column:
    """Typographic quotes, dashes, the ellipsis and special spaces in plain ASCII."""
    table = C.QUOTES | C.DASHES | C.SPACES
    return F.translate(F.replace(text, F.lit(C.ELLIPSIS), F.lit("...")), "".join(table), "".join(table.values()))


def space_sentences(text: Column) -> Column:
    """A space between a sentence's end and a capitalised word glued to it."""
    return F.regexp_replace(text, r"(?<=[a-z][.!?])(?=[A-Z][a-z])", " ")


def remove_patterns(text: Column, patterns: list[str]) -> tuple[Column, Column]:
    """(text with each match turned into a space, characters removed); patterns see each other's result."""
    removed = F.lit(0)
    for p in patterns:
        hits = F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1))
        removed = removed + F.aggregate(hits, F.lit(0), lambda a, x: a + F.length(x))
        text = F.regexp_replace(text, p, " ")
    return text, removed


def tidy_whitespace(text: Column) -> Column:
    """Single spaces, none before closing or after opening marks; never joins digits to a new number."""
    for p, to in ((r"(?U)\(\s*\)|\[\s*\]", " "), (r"(?U)\s+", " "), (r"(?U)([.!?])(?:\s+[.,;:])+(?=\s|$)", "$1"), (r"(?U)\s+([.,;:!?)\]])(?!\d)", "$1"), (r"(?U)([(\[])\s+", "$1")):
        text = F.regexp_replace(text, p, to)
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def drop_repeated_title(text: Column, title: Column) -> Column:
    """The text without a leading copy of the title, if words end where the title ends."""
    head = _collapsed(fold_punctuation(title))
    body = F.regexp_replace(text, r"(?U)^\s+", "")
    words = F.split(head, " ")
    first = F.array_join(F.slice(F.split(_collapsed(body), " "), F.lit(1), F.size(words)), " ")
    # Cut as many words as the title has from the original characters.
    rest = F.regexp_replace(body, F.concat(F.lit(r"(?U)^(?:\S+(?:\s+|$)){"), F.size(words).cast("string"), F.lit("}")), F.lit(""))
    return F.when((head != "") & (F.lower(first) == F.lower(head)), rest).otherwise(text)


def article_id(link: Column) -> Column:
    return F.substring(F.sha2(F.trim(link), 256), 1, 16)


def uuid5(name: Column, namespace: str = C.POINT_NAMESPACE) -> Column:
    """The name-based UUID of version 5."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))).cast("long")))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(article: Column, index: Column) -> Column:
    return uuid5(F.concat(article, F.lit(":"), index.cast("string")))


def words(text: Column) -> Column:
    """Runs of letters, digits and underscores, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def word_count(text: Column) -> Column:
    """Words between white space."""
    t = _collapsed(text)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, " ")))


def stem(word: Column) -> Column:
    """Crude folding of inflections: the first suffix that leaves three letters goes; ies and ied become y."""
    w = F.rtrim(F.lower(word), F.lit("'"))
    out = F.rtrim(w, F.lit("e"))
    for s in reversed(C.SUFFIXES):
        base = w.substr(F.lit(1), F.length(w) - len(s))
        out = F.when(w.endswith(s) & (F.length(w) - len(s) >= 3), F.concat(base, F.lit("y")) if s in ("ies", "ied") else F.rtrim(base, F.lit("e"))).otherwise(out)
    return out


def stem_word(word: str) -> str:
    """The same for the words of a rule, at planning time."""
    word = word.lower().rstrip("'")
    for s in C.SUFFIXES:
        if word.endswith(s) and len(word) - len(s) >= 3:
            return word[: -len(s)] + "y" if s in ("ies", "ied") else word[: -len(s)].rstrip("e")
    return word.rstrip("e")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets held as arrays; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def title_tokens(title: Column) -> Column:
    """Distinct words of a title without a leading ``Update:``."""
    return F.array_distinct(words(F.regexp_replace(title, r"(?i)^\s*update:\s*", "")))


def shingle_set(text: Column, n: int = C.SHINGLE) -> Column:
    """Distinct runs of n words; a shorter text gives one run of all its words."""
    runs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))
    return let(words(text), lambda w: F.when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(runs(w)))


def shingle_hashes(text: Column, n: int = C.SHINGLE) -> Column:
    """The same set as 64-bit hashes, which array functions compare without boxing."""
    runs = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, n))))
    return let(words(text), lambda w: F.when(F.size(w) < n, F.array(F.xxhash64(w))).otherwise(runs(w)))


def without_references(text: Column) -> Column:
    """Folded text without [n] marks and wording such as ``sources 1 and 4``."""
    return F.regexp_replace(F.regexp_replace(fold_punctuation(text), r"\[\d+\]", " "), r"(?iU)\bsources? \d+(?:\s*(?:,|and|&)\s*\d+)*", " ")


def numbers(text: Column) -> Column:
    """Distinct plain numbers as strings, thousands separators dropped, sorted."""
    found = F.regexp_extract_all(without_references(text), F.lit(rf"(?U)(?<![\w.])((?:\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.\d+)?)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")))))


def quantities(text: Column) -> Column:
    """Distinct array<struct<value decimal(38,12), is_percent boolean>>, sorted; figures compare by value.

    Scale words and attached letters multiply; percent is a kind of its own; the first end of a range without a
    unit borrows that of the second. A figure beyond 26 whole digits has a null value and matches nothing.
    """
    names = ("i", "f", "p", "w", "l", "p2", "w2", "l2")

    def one(x: Column) -> Column:
        own = (x["p"] != "") | (x["w"] != "") | (x["l"] != "")
        scale = F.lower(F.when(own, F.concat(x["w"], x["l"])).otherwise(F.concat(x["w2"], x["l2"])))
        pct = F.when(own, x["p"] != "").otherwise(x["p2"] != "")
        by = F.when(scale.isin("trillion", "tn", "t"), F.lit(10**12)).when(scale.isin("billion", "bn", "b"), F.lit(10**9)).when(scale.isin("million", "mn", "m"), F.lit(10**6)).when(scale.isin("thousand", "k"), F.lit(10**3)).otherwise(F.lit(1))
        digits = F.concat(F.replace(x["i"], F.lit(","), F.lit("")), F.lit("."), x["f"], F.lit("0"))
        value = (digits.try_cast("decimal(26,9)") * by.cast("decimal(13,0)")).try_cast("decimal(38,12)")
        return F.struct(value.alias("value"), pct.alias("is_percent"))

    parts = lambda t: F.arrays_zip(*[F.regexp_extract_all(t, F.lit(QUANTITY), F.lit(i)).alias(n) for i, n in enumerate(names, 1)])
    return F.array_sort(F.array_distinct(F.transform(let(without_references(text), parts), one)))


def citations(sentence: Column) -> Column:
    return F.transform(F.regexp_extract_all(sentence, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))


def strip_citations(sentence: Column) -> Column:
    return _collapsed(F.regexp_replace(sentence, r"(?U)\s*\[\d+\]", ""))


def drop_unknown_citations(sentence: Column, known: Column) -> Column:
    """Without the marks of sources that do not exist."""
    unknown = F.array_except(citations(sentence), known)
    return F.aggregate(unknown, sentence, lambda s, n: F.replace(s, F.concat(F.lit("["), n.cast("string"), F.lit("]")), F.lit("")))


def is_lead_in(sentence: Column) -> Column:
    return (F.size(quantities(sentence)) == 0) & F.rtrim(sentence).endswith(":")


def any_match(text: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns], F.lit(False))


def first_match(text: Column, patterns: list[str]) -> Column:
    """The first pattern's matching text, else null."""
    return F.coalesce(*[F.when(text.rlike(p), F.regexp_extract(text, f"(?:{p})" if not p.startswith("(?i)") else f"(?i)(?:{p[4:]})", 0)) for p in patterns])


def quote(text: str) -> str:
    """A literal in a Java pattern."""
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)
