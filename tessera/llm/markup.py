"""Markup residue in texts: wrappers inferred from a host's other texts find it, and clean text is made from their slots and groups.

Texts are read into token streams and candidate trees (``marks``), which is not yet to call anything
markup: nearly every text has stars, brackets or braces. Union-free wrappers are then inferred for each host (``wrappers``), and a text's tree
is markup if a wrapper that other texts gave takes it. In the clean text of a tree the wrapper's slots are kept,
its repeated groups become list items, rows and cells, and its marks go. A refused tree stays as it stands, but for markup inside it.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize
from .marks import FENCE, candidates
from .wrappers import ALL_FOLDS, EVERYWHERE, FOLDS, Judge, forms, generalise, infer, is_construct

__all__ = ["clean", "infer", "marked", "prose_blocks", "render", "tidy"]

#: Rows that are cleaned in one group, about.
GROUP_ROWS = 4096
#: How constructs are written, by name. Names not here keep their slots in place.
_BLOCKS = {"html:p", "html:div", "html:section", "html:article", "html:blockquote", "html:body", "html:html", "html:dd", "html:dt", "html:dl", "html:figure"}
_LISTS = {"html:ul": "- ", "html:ol": "1. ", "latex:env:itemize": "- ", "latex:env:enumerate": "1. "}
_DROPPED = {"html:!", "html:script", "html:style", "html:head", "html:nav", "html:ref", "html:ref/", "html:img/", "rst:rule", "rst:::", "md:linkdef", "md:>", "latex:centering/", "latex:noindent/", "latex:par/", "latex:maketitle/"}
_SILENT = {f"latex:{c}" for c in "cite citep citet ref eqref label footnote pageref index".split()}
_NOTES = {"note", "warning", "tip", "rubric", "admonition", "versionadded", "versionchanged", "deprecated"}


def render(parts: list, judge) -> str:
    """Clean text of strings and trees; ``judge`` gives a tree's wrapper or None. What stands in a tree was taken with it."""
    out = []
    for p in parts:
        if isinstance(p, str):
            out.append(p)
            continue
        wrapper = judge(p)
        if wrapper is not None:
            out.append(_write(p, wrapper))
        elif p[0] != "wiki:table" and any(judge(c) is not None for c in _inside(p)):
            out.append(p[4][0] + render(p[1], judge) + p[4][1])
        else:
            out.append(p[3])
    return "".join(out)


def _inside(node: list):
    """All trees in a tree."""
    todo = [c for c in node[1] if not isinstance(c, str)]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in n[1] if not isinstance(c, str)]


def _part_of(wrapper: dict, name: str) -> dict | None:
    """The wrapper of a child."""
    return next((w for _, w, _ in wrapper["c"] if w and w["n"] == name), None)


def _groups(wrapper: dict) -> set[str]:
    """Children that the wrapper repeats; if it repeats none, because lists of one were all it saw, its marks."""
    marks = [(kind, w["n"]) for kind, w, _ in wrapper["c"] if w]
    return {n for kind, n in marks if kind in "+*"} or {n for _, n in marks}


def _slots(node: list, wrapper: dict) -> str:
    """The slots of a tree in place."""
    return "".join(_child(c, wrapper) for c in node[1])


def _child(c, wrapper: dict) -> str:
    if isinstance(c, str):
        return c
    return _write(c, _part_of(wrapper, c[0]) or generalise(c)) if is_construct(c) else c[3]


def _flat(node: list, wrapper: dict) -> str:
    return " ".join(_slots(node, wrapper).split())


def _items(node: list, wrapper: dict) -> list[str]:
    """One line for each member of the repeated group; what stands between them goes to the member before."""
    repeated, lines = _groups(wrapper), []
    for c in node[1]:
        text = " ".join(_child(c, wrapper).split())
        if not isinstance(c, str) and c[0] in repeated:
            lines.append(text)
        elif text:
            lines[-1:] = [f"{lines[-1]} {text}".strip()] if lines else [text]
    return lines


def _rows(node: list, wrapper: dict) -> list[str]:
    """Lines of the rows of a table, whatever holds them; a row's repeated group are its cells."""
    lines = []
    for c in node[1]:
        if is_construct(c):
            w = _part_of(wrapper, c[0]) or generalise(c)
            if c[0] in ("html:tr", "wiki:row"):
                cells = _groups(w)
                lines.append("| " + " | ".join(_flat(x, _part_of(w, x[0]) or generalise(x)) for x in c[1] if is_construct(x) and (x[0] in cells or x[0].endswith(("td", "th", "cell")))) + " |")
            elif c[0] == "html:caption":
                lines.append(_flat(c, w))
            else:
                lines += _rows(c, w)
    return lines


def _write(node: list, wrapper: dict) -> str:
    name, _, data = node[:3]
    if name == "html:&":
        return data
    if name in _DROPPED or name in _SILENT or name.startswith(("html:/", "latex:/", "wiki:{|", "wiki:|")):
        return ""
    if name in ("latex:math", "rst:math"):
        return f"${data}$"
    if name == "html:math":
        return f"${''.join(_slots(node, wrapper).split())}$"
    if re.fullmatch(r"latex:env:(equation|align|displaymath|math|gather|eqnarray)\*?", name):
        return f"\n$${_slots(node, wrapper).strip()}$$\n"
    if name in ("md:heading", "wiki:heading", "rst:title", "latex:heading") or re.fullmatch(r"html:h[1-6]|html:title|html:caption", name):
        return f"\n{_flat(node, wrapper)}\n"
    if name == "html:pre" or re.fullmatch(r"latex:env:(verbatim|lstlisting|minted)\*?", name):
        return "\n```\n" + _slots(node, wrapper).strip("\n") + "\n```\n"
    if name in _LISTS:
        mark = _LISTS[name]
        return "\n" + "\n".join((f"{i}. " if mark == "1. " else mark) + line for i, line in enumerate(_items(node, wrapper), 1)) + "\n"
    if name in ("html:table", "wiki:table"):
        return "\n" + "\n".join(_rows(node, wrapper)) + "\n"
    if name in ("md:task", "md:autolink"):
        return data
    if name.startswith("rst:.."):
        return (f"\n${data}$\n" if name[6:] == "math" else f"\n{data}\n" if name[6:] in _NOTES else "\n") if data else "\n"
    if name in ("html:br/", "html:hr/"):
        return "\n"
    if name == "latex:item/":
        return "- "
    inner = _slots(node, wrapper)
    return f"\n{inner.strip()}\n" if name in _BLOCKS else inner


def tidy(text: str) -> str:
    """No blanks before line ends, no runs of spaces inside lines of prose, at most one blank line."""
    out, at = [], 0
    for m in [*FENCE.finditer(text), None]:
        plain = text[at : m.start() if m else len(text)]
        plain = re.sub(r"[ \t ]+$", "", re.sub(r"(?<=\S)[ \t ]{2,}(?=\S)", " ", plain), flags=re.M)
        out.append(re.sub(r"\n{3,}", "\n\n", plain))
        if m:
            out.append(m[0])
            at = m.end()
    return "".join(out).strip()


def held(parts: list, judge) -> list[str]:
    """Names of the outermost trees that are markup."""
    names, todo = [], [p for p in reversed(parts) if not isinstance(p, str)]
    while todo:
        n = todo.pop()
        if judge(n) is not None:
            names.append(n[0])
        else:
            todo += [c for c in reversed(n[1]) if not isinstance(c, str)]
    return names


# ---- over tables


def marked(rows: DataFrame, key: list[str], text: str = "text", url: str = "url") -> DataFrame:
    """``key``, host, fold, text and forms (name, form) of every text with candidate trees."""
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][\w+.-]*://([^/:?#]+)", 1)), F.lit(""))
    possible = F.col(text).rlike(r"[<&*_~\[\]{}\\:`#>=|'.-]")
    source = rows.select(*[F.col(k).alias(f"key{i}") for i, k in enumerate(key)], host.alias("host"), F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int").alias("fold"), F.col(text).alias("text")).where(possible)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)
    kind = pa.list_(pa.struct([("name", pa.string()), ("form", pa.string())]))

    def run(batches):
        for batch in batches:
            keep, found = [], []
            for i, value in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                mine = forms(candidates(value))
                if mine:
                    keep.append(i)
                    found.append([{"name": n, "form": f} for n, f in sorted(mine)])
            kept = [c.take(pa.array(keep, pa.int64())) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, kind)], names=[*batch.schema.names, "forms"])

    return source.mapInArrow(run, f"{fields}, forms array<struct<name: string, form: string>>")


def clean(rows: DataFrame, key: list[str], text: str = "text", url: str = "url") -> DataFrame:
    """``key``, clean_text, kinds (names of the outermost constructs, sorted), n_marks of every text with markup.

    Texts without markup, null and empty ones give no rows: they are clean. A tree is markup if a wrapper of the same host, or of
    all hosts, that was aligned over other folds takes it; so a form that stands in a single text of the whole table, and whose
    family does too, stays text. A host's rows are cleaned in groups of about ``GROUP_ROWS``. Repeated rows are cleaned each;
    a null url is a host of its own.
    """
    found = materialize(marked(rows, key, text, url), "marked")
    inferred = materialize(infer(found).where(F.col("fold") != ALL_FOLDS), "wrappers")
    sizes = found.groupBy("host", "fold").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("salts"))
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    own = inferred.where(F.col("host") != EVERYWHERE).select("host", "fold", F.lit(True).alias("own"), "name", "wrapper")
    every = sizes.select("host", "fold").join(inferred.where(F.col("host") == EVERYWHERE).select("fold", "name", "wrapper"), "fold").select("host", "fold", F.lit(False).alias("own"), "name", "wrapper")
    known = salted(own.unionByName(every).join(sizes, ["host", "fold"])).select(*[F.col(c).alias(f"w_{c}") for c in ("host", "fold", "salt", "own", "name", "wrapper")])
    texts = found.drop("forms").join(sizes, ["host", "fold"]).withColumn("salt", F.pmod(F.xxhash64("text", F.lit(5)), F.col("salts")).cast("int")).drop("salts")
    keys = [f"key{i}" for i in range(len(key))]
    fields = ", ".join(f"`{k}` {found.schema[k].dataType.simpleString()}" for k in keys)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        wrappers: dict[bool, dict] = {True: {}, False: {}}
        for own, name, w in zip(*(right.column(f"w_{c}").to_pylist() for c in ("own", "name", "wrapper"))):
            wrappers[own][name] = json.loads(w)
        judge = Judge(wrappers[True], wrappers[False])
        cleaned, kinds, counts, keep = [], [], [], []
        for i, value in enumerate(left.column("text").to_pylist()):
            parts = candidates(value)
            names = held(parts, judge)
            if names:
                keep.append(i)
                cleaned.append(tidy(render(parts, judge)))
                kinds.append(sorted(set(names)))
                counts.append(len(names))
        kept = left.select(keys).take(pa.array(keep, pa.int64()))
        return pa.table({k: kept.column(k) for k in keys} | {"clean_text": pa.array(cleaned, pa.string()), "kinds": pa.array(kinds, pa.list_(pa.string())), "n_marks": pa.array(counts, pa.int32())})

    groups = ["host", "fold", "salt"]
    out = texts.groupBy(*groups).cogroup(known.groupBy(*[f"w_{g}" for g in groups])).applyInArrow(run, f"{fields}, clean_text string, kinds array<string>, n_marks int")
    return out.select(*[F.col(k).alias(name) for k, name in zip(keys, key)], "clean_text", "kinds", "n_marks")


def prose_blocks(blocks: DataFrame) -> DataFrame:
    """Blocks whose kind, however spelled, isn't code; a null kind counts as prose."""
    kind: Column = F.lower(F.trim(F.coalesce("kind", F.lit(""))))
    return blocks.where(~kind.startswith("code"))
