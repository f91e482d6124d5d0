"""Splitting texts above a size limit at natural boundaries, by lexical cohesion.

Where a topic changes, the words before and after have little in common: the similarity of the
blocks on both sides of a boundary has a valley. Within each window of sizes the natural boundary
with the deepest valley is cut; each piece but the first repeats the last words of the one before.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 512, 40
#: Words of the block on each side of a boundary, and the least share of the room that a piece should use.
BLOCK, LEAST_SHARE = 40, 0.5
#: A word is a longest run without these characters.
BLANKS = " \t\n\r"
_WORD = re.compile(f"[^{BLANKS}]+")
_STEM = re.compile(r"[^\W_]+")
#: What a boundary is worth beside its valley's depth: ends of paragraphs, of lines, of sentences.
PARAGRAPH, LINE, SENTENCE = 0.3, 0.15, 0.0
_END = re.compile(r"[.!?…][\"'”’)\]]*$")


def n_words(text: str | Column) -> Column:
    """Number of words of a text; 0 for a null one."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.size(F.filter(F.split(c, f"[{BLANKS}]+"), lambda w: w != "")), F.lit(0))


def boundaries(text: str, spans: list[tuple[int, int]]) -> dict[int, float]:
    """Natural boundaries: the number of words before each, and its worth. Inside fenced code only line ends count."""
    found, code = {}, False
    for i in range(len(spans)):
        start, end = spans[i]
        if text.startswith("```", start) and (i == 0 or "\n" in text[spans[i - 1][1] : start] or "\r" in text[spans[i - 1][1] : start]):
            code = not code
        if i + 1 == len(spans):
            break
        gap = text[end : spans[i + 1][0]]
        lines = gap.replace("\r\n", "\n").replace("\r", "\n").count("\n")
        if lines and code:
            found[i + 1] = SENTENCE
        elif lines > 1:
            found[i + 1] = PARAGRAPH
        elif lines:
            found[i + 1] = LINE
        elif not code and _END.search(text[start:end]):
            found[i + 1] = SENTENCE
    return found


def depths(terms: list[str], at: list[int], block: int) -> dict[int, float]:
    """Depth of the similarity valley at each boundary: how far similarity rises to the nearest peak on both sides."""
    sims = []
    for i in at:
        a, b = Counter(t for t in terms[max(0, i - block) : i] if t), Counter(t for t in terms[i : i + block] if t)
        norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
        sims.append(sum(v * b[t] for t, v in a.items()) / norm if norm else 0.0)
    up_left, up_right = list(sims), list(sims)
    for i in range(1, len(sims)):
        if sims[i - 1] >= sims[i]:
            up_left[i] = up_left[i - 1]
    for i in range(len(sims) - 2, -1, -1):
        if sims[i + 1] >= sims[i]:
            up_right[i] = up_right[i + 1]
    return {i: up_left[j] + up_right[j] - 2 * sims[j] for j, i in enumerate(at)}


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> list[tuple[int, int, int, int, str]]:
    """Pieces as (start, end) in characters, first and last word (exclusive), and how the piece ends: natural, forced or end.

    Pieces are substrings of the text, at most ``limit`` words each. If no natural boundary lies in
    the window, the last one before it is taken; if there is none, the cut is forced at the limit.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be below the limit")
    spans = [m.span() for m in _WORD.finditer(text)]
    if len(spans) <= limit:
        return [(0, len(text), 0, len(spans), "end")]
    worth = boundaries(text, spans)
    terms = ["".join(_STEM.findall(text[a:b].lower())) for a, b in spans]
    at = sorted(worth)
    depth = depths(terms, at, block)
    pieces, done = [], 0
    while True:
        first = max(0, done - overlap) if pieces else 0
        most = first + limit
        begin = spans[first][0] if pieces else 0
        if most >= len(spans):
            pieces.append((begin, len(text), first, len(spans), "end"))
            return pieces
        least = done + max(1, math.ceil((most - done) * LEAST_SHARE))
        window = [i for i in at if least <= i <= most] or [i for i in at if done < i < least][-1:]
        end = max(window, key=lambda i: (depth[i] + worth[i], i)) if window else most
        pieces.append((begin, spans[end - 1][1], first, end, "natural" if window else "forced"))
        done = end


def split(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, item: str = "chunk_id", text: str = "text", keep: tuple[str, ...] = ("heading_path",)) -> DataFrame:
    """Pieces of every text above ``limit`` words: item, keep, piece_no (from 0), n_pieces, text, n_words, ends.

    Texts within the limit, null and empty ones give no rows: they stay as they are. Whole texts are
    read, whatever a stored length says. Only oversized rows reach Python; there is no shuffle. Repeated
    rows are split each; null items and headings are kept.
    """
    source = chunks.select(item, *keep, F.col(text).alias("__text")).where(n_words("__text") > limit)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])

    def run(batches):
        for batch in batches:
            rows, texts, numbers, totals, sizes, ends = [], [], [], [], [], []
            for i, value in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                pieces = cuts(value, limit, overlap)
                for no, (a, b, first, last, how) in enumerate(pieces):
                    rows.append(i)
                    texts.append(value[a:b])
                    numbers.append(no)
                    totals.append(len(pieces))
                    sizes.append(last - first)
                    ends.append(how)
            kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
            made = [pa.array(numbers, pa.int32()), pa.array(totals, pa.int32()), pa.array(texts, pa.string()), pa.array(sizes, pa.int32()), pa.array(ends, pa.string())]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*batch.schema.names[:-1], "piece_no", "n_pieces", "text", "n_words", "ends"])

    return source.mapInArrow(run, f"{fields}, piece_no int, n_pieces int, text string, n_words int, ends string")
