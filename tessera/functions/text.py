"""Column expressions over texts, URLs, hashes and headings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without weight in a search query.
STOPWORDS = (
    "a an and are as at be by do does for from how i if in into is it its of on or that the to what when where which who why with you your "
    "me my we our will can should would could doing done get got make made use used using want need"
).split()
#: Device namespaces that must agree between alias pages.
DEVICES = r"\b(cuda|xpu|mtia|mps|cpu|hpu|npu)\b"
#: What a placeholder page says, in lower case, and its greatest length in tokens.
STUB_PHRASES = (
    "was deprecated", "has been deprecated", "have been deprecated", "has been moved", "have been moved",
    "no longer actively supported", "redirecting in", "redirecting now", "will redirect", "you will be redirected",
)
STUB_MAX_TOKENS = 80
#: White space as Python's str.split sees it; Java's \s is ASCII only.
SPACE = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def collapse_spaces(text: str | Column) -> Column:
    """Runs of white space become one space; none at the ends. Null stays null."""
    return F.trim(F.regexp_replace(_c(text), f"{SPACE}+", " "))


def word_count(text: str | Column) -> Column:
    """Number of words between white space; 0 for an empty text, null for null."""
    return F.when(_c(text).isNotNull(), F.size(F.filter(F.split(_c(text), f"{SPACE}+"), lambda w: w != "")))


def short_identifiers(text: str | Column) -> Column:
    """Dotted identifiers become their last segment."""
    return F.regexp_replace(_c(text), r"\b(?:[A-Za-z_][A-Za-z0-9_]*\.)+([A-Za-z_][A-Za-z0-9_]*)\b", "$1")


def path_segments(url: str | Column) -> Column:
    """Dotted segments of a URL's last path part, without ``.html`` and then ``_class``; empty for an empty part."""
    last = F.element_at(F.split(F.regexp_replace(_c(url), "/+$", ""), "/"), -1)
    base = F.regexp_replace(F.regexp_replace(last, r"\.html$", ""), "_class$", "")
    return F.when(base == "", F.array().cast("array<string>")).otherwise(F.split(base, r"\."))


def is_subsequence(a: Column, b: Column) -> Column:
    """Whether the elements of array ``a`` stand in ``b`` in order, with or without gaps."""
    # the fold carries how much of b is used up; -1 once an element is missing
    def step(used: Column, x: Column) -> Column:
        rest = F.slice(b, used + 1, F.greatest(F.size(b) - used, F.lit(0)))
        at = F.array_position(rest, x).cast("int")
        return F.when(used < 0, used).when(at == 0, F.lit(-1)).otherwise(used + at)

    return F.aggregate(a, F.lit(0), step) >= 0


def device_set(segments: Column) -> Column:
    """Devices named in a path, sorted, each once."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.array_join(segments, "."), F.lit(DEVICES), F.lit(1))))


def alias_compatible(url_a: str | Column, url_b: str | Column) -> Column:
    """Whether two pages of equal text may be one object under two paths: same devices, one path a subsequence of the other."""
    a, b = path_segments(url_a), path_segments(url_b)
    return (device_set(a) == device_set(b)) & (is_subsequence(a, b) | is_subsequence(b, a))


def says_stub(text: Column) -> Column:
    """Whether a text says that it was moved or deprecated."""
    low = F.lower(text)
    said = low.contains(STUB_PHRASES[0])
    for p in STUB_PHRASES[1:]:
        said = said | low.contains(p)
    return said


def is_stub(n_chunks: Column, n_tokens: Column, said: Column) -> Column:
    """One short chunk that says it was moved or deprecated; false if a part is null."""
    return F.coalesce((n_chunks == 1) & (n_tokens <= STUB_MAX_TOKENS) & said, F.lit(False))


def match_terms(query: str | Column) -> Column:
    """Search terms of a free text in order, each once: names, dotted names with their parts, numbers; no stopwords."""
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    raw = F.regexp_extract_all(_c(query), F.lit(r"[A-Za-z_][A-Za-z0-9_.]*|\d+"), F.lit(0))
    terms = F.transform(raw, lambda t: F.lower(F.regexp_replace(t, r"^\.+|\.+$", "")))
    terms = F.filter(terms, lambda t: (t != "") & ~F.array_contains(stop, t))
    parts = lambda t: F.filter(F.split(t, r"\."), lambda p: (p != "") & ~F.array_contains(stop, p))
    return F.array_distinct(F.flatten(F.transform(terms, lambda t: F.when(t.contains("."), F.concat(F.array(t), parts(t))).otherwise(F.array(t)))))


def match_expression(query: str | Column) -> Column:
    """The terms quoted and joined by OR; '' if nothing is searchable."""
    return F.array_join(F.transform(match_terms(query), lambda t: F.concat(F.lit('"'), t, F.lit('"'))), " OR ")


def embedding_text(title: str | Column, heading_path: str | Column, text: str | Column) -> Column:
    """Title, heading path and text, one a line; empty ones are left out."""
    path = F.array_join(F.coalesce(_c(heading_path), F.array().cast("array<string>")), " > ")
    return F.array_join(F.filter(F.array(_c(title), path, _c(text)), lambda x: x.isNotNull() & (x != "")), "\n")


def snippet(text: str | Column, length: int = 220) -> Column:
    """One line of at most ``length`` characters, and ``...`` if that cut it."""
    flat = collapse_spaces(text)
    return F.when(F.length(flat) > length, F.concat(F.rtrim(F.substring(flat, 1, length)), F.lit("..."))).otherwise(flat)


def section_label(heading_path: str | Column) -> Column:
    """The last two headings."""
    p = F.coalesce(_c(heading_path), F.array().cast("array<string>"))
    return F.array_join(F.slice(p, F.greatest(F.size(p) - 1, F.lit(1)), 2), " > ")


def unit_key(url: str | Column, anchor: str | Column) -> Column:
    """The judged unit: the url, with ``#anchor`` where there is one."""
    return F.when(F.coalesce(_c(anchor), F.lit("")) != "", F.concat(_c(url), F.lit("#"), _c(anchor))).otherwise(_c(url))


def source_of_url(url: str | Column) -> Column:
    return F.when(F.instr(_c(url), "/tutorials/") > 0, "tutorials").otherwise("docs")


def chunk_id(url: str | Column, heading_path: str | Column, index: Column) -> Column:
    """Positional id: hash of the url, the heading path and the number within it."""
    key = F.concat_ws("\0", _c(url), F.array_join(_c(heading_path), "/"), index.cast("string"))
    return F.substring(F.sha2(key, 256), 1, 16)


def content_hash(text: str | Column) -> Column:
    return F.substring(F.sha2(_c(text), 256), 1, 16)


def cache_key(*parts: Column) -> Column:
    """Hash of the parts, each followed by a zero byte."""
    return F.sha2(F.concat(*[x for p in parts for x in (p, F.lit("\0"))]), 256)


def context_block(passages: str | Column) -> Column:
    """Numbered passages of an ordered array of structs with title, heading_path and text."""
    def one(p: Column, i: Column) -> Column:
        head = F.array_join(F.filter(F.array(p["title"], F.array_join(p["heading_path"], " > ")), lambda x: x.isNotNull() & (x != "")), " | ")
        return F.concat(F.lit("[C"), (i + 1).cast("string"), F.lit("] "), head, F.lit("\n"), F.coalesce(p["text"], F.lit("")))

    return F.array_join(F.transform(_c(passages), one), "\n\n")


def human_bytes(n: str | Column) -> Column:
    kib = _c(n) / 1024
    return F.when(kib < 1024, F.format_string("%.1f KiB", kib)).otherwise(F.format_string("%.1f MiB", kib / 1024))


def bars(n: Column, most: Column, width: int = 40) -> Column:
    """A bar of ``#`` in proportion to the greatest value."""
    return F.expr("repeat('#', 0)") if width <= 0 else F.repeat(F.lit("#"), F.coalesce(F.round(n * width / F.nullif(most, F.lit(0))), F.lit(0)).cast("int"))


def all_of(conditions: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
