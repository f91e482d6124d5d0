"""Text analysis for the search index: words in lower case, folded to base letters, stemmed after Porter (1980).

``analyze`` runs in one Arrow pass with a cache of words a worker; ``plain_words`` is the JVM form
without folding and stems.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_CACHE: dict[str, str] = {}
_CACHE_WORDS = 500_000


def _is_consonant(w: str, i: int) -> bool:
    c = w[i]
    return c not in "aeiou" and not (c == "y" and i > 0 and _is_consonant(w, i - 1))


def _shape(w: str) -> str:
    """The word as runs of consonants (c) and vowels (v)."""
    out = ""
    for i in range(len(w)):
        kind = "c" if _is_consonant(w, i) else "v"
        if not out.endswith(kind):
            out += kind
    return out


def _measure(w: str) -> int:
    return _shape(w).count("vc")


def _short_end(w: str) -> bool:
    """Consonant, vowel, consonant other than w, x and y."""
    return len(w) > 2 and _is_consonant(w, len(w) - 3) and not _is_consonant(w, len(w) - 2) and _is_consonant(w, len(w) - 1) and w[-1] not in "wxy"


#: Porter's suffixes of steps 2, 3 and 4, longest first where one ends another.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("logi", "log"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _replace(w: str, table: tuple, least: int) -> str:
    hits = [(s, r) for s, r in table if w.endswith(s)]
    if hits:
        s, r = max(hits, key=lambda p: len(p[0]))
        if _measure(w[: -len(s)]) > least:
            return w[: -len(s)] + r
    return w


def porter(w: str) -> str:
    """Porter's stem of a word in lower case; words below 3 letters stay."""
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for s in ("ed", "ing"):
            if w.endswith(s) and "v" in _shape(w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _is_consonant(w, len(w) - 1) and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short_end(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _replace(_replace(w, _STEP2, 0), _STEP3, 0)
    hits = [s for s in _STEP4 if w.endswith(s)]
    if hits:
        s = max(hits, key=len)
        stem = w[: -len(s)]
        if _measure(stem) > 1 and (s != "ion" or stem.endswith(("s", "t"))):
            w = stem
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _short_end(stem)):
            w = stem
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def fold(word: str) -> str:
    """Lower case; Latin letters without diacritics."""
    if word.isascii():
        return word.lower()
    parts = (unicodedata.normalize("NFD", c) for c in word.lower())
    return "".join(p[0] if p[0].isascii() else unicodedata.normalize("NFC", p) for p in parts if not unicodedata.combining(p[0]))


def terms_of(text: str | None, stem: bool = True) -> list[str]:
    """Terms in order: runs of letters, digits and underscores, folded and stemmed."""
    import regex

    if not text:
        return []
    if len(_CACHE) > _CACHE_WORDS:
        _CACHE.clear()
    out = []
    for w in regex.findall(r"[\p{L}\p{N}\p{M}\p{Co}_]+", text):
        if not stem:
            out.append(fold(w))
            continue
        t = _CACHE.get(w)
        if t is None:
            f = fold(w)
            t = _CACHE[w] = porter(f) if len(f.encode()) < 64 else f
        out.append(t)
    return out


def analyze(rows: DataFrame, keep: list[str], columns: list[str], stem: bool = True) -> DataFrame:
    """``keep`` columns as they are and ``columns`` (string) as arrays of terms; null gives an empty array."""
    source = rows.select(*keep, *columns)
    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[: len(keep)]]
    n = len(keep)

    def run(batches):
        for batch in batches:
            lists = [pa.array([terms_of(t, stem) for t in c.to_pylist()], pa.list_(pa.string())) for c in batch.columns[n:]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *lists], names=batch.schema.names)

    return source.mapInArrow(run, ", ".join([*head, *[f"`{c}` array<string>" for c in columns]]))


def plain_words(text: str | Column) -> Column:
    """Runs of a-z, digits and underscore of the text in lower case; null gives an empty array."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0)), F.array().cast("array<string>"))
