"""Union-free wrappers of markup, inferred for each host from the token streams of its texts.

A wrapper is {"n": name, "c": children}, a child [kind, wrapper or null for a text slot, constant text or null] and kind
one of 1 ? + *. The trees of a host are aligned one after the other: different texts become a slot, children
that one lacks optional, neighbours of a name a repeated group. Only forms, trees without wording, are compared, so what is
aligned grows with the variety of markup and not with the corpus.

Texts are cut into folds by their hash. A text is read with wrappers aligned over the other folds of its host, so that no
text, and no copy of it, vouches for itself. Beside the wrapper of a name there is one for its family (all tags,
all runs of stars), for the host and for all hosts, which speak for names that stand once.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEXT = "#TEXT"
#: Parts of a host's texts; each is read with what the others give.
FOLDS = 8
#: Forms that are aligned in one task, about.
FORMS_A_PART = 1000
#: The host under which all hosts' forms are aligned, and the fold of a wrapper over all folds.
EVERYWHERE, ALL_FOLDS = "*", -1


def family(name: str) -> str:
    """What a construct's marks look like, whatever their name."""
    language, _, rest = name.partition(":")
    if language == "html" and rest not in ("&", "!"):
        return "html: end" if rest.startswith("/") else "html: tag" if rest.endswith("/") else "html: element"
    if language == "latex" and rest != "math":
        return "latex: edge" if rest.startswith("/") or re.fullmatch("env:.*/", rest) else "latex: environment" if rest.startswith("env:") else "latex: word" if rest.endswith("/") else "latex: command"
    if language == "rst" and rest.startswith(".."):
        return "rst: directive"
    sign = re.fullmatch(r"(\*|_|')+", rest)
    return f"{language}: {sign[1]}" if sign else name


def is_construct(part) -> bool:
    """Whether a part of a text is a tree; a delimiter without its mirror is text."""
    return not isinstance(part, str) and not part[0].endswith(" alone")


def _children(node: list) -> list:
    """What a wrapper sees of a node: constructs, and texts that aren't blank."""
    return [c for c in node[1] if is_construct(c) or not isinstance(c, str) or c.strip()]


def generalise(node: list) -> dict:
    """The wrapper of one construct: blank text goes, neighbours of a name become a repeated group."""
    kids = [["1", generalise(c), None] if is_construct(c) else ["1", None, (c if isinstance(c, str) else c[3]).strip()] for c in _children(node)]
    return {"n": node[0], "c": _runs(kids)}


def _name(item: list) -> str:
    return item[1]["n"] if item[1] else TEXT


def _runs(kids: list) -> list:
    out: list = []
    for k in kids:
        if out and _name(out[-1]) == _name(k):
            merged = align(out[-1][1], k[1]) if k[1] else None
            same = out[-1][2] if out[-1][2] == k[2] else None
            out[-1] = ["1" if not k[1] else "*" if out[-1][0] in "?*" and k[0] in "?*" else "+", merged, same]
        else:
            out.append(list(k))
    return out


def _both(a: str, b: str, one_only: bool = False) -> str:
    optional, repeated = one_only or a in "?*" or b in "?*", a in "+*" or b in "+*"
    return "*" if optional and repeated else "?" if optional else "+" if repeated else "1"


def align(a: dict, b: dict) -> dict:
    """The least wrapper over both: children are aligned by name; what only one has becomes optional, different texts a slot."""
    if a == b:
        return a
    x, y = a["c"], b["c"]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if _name(x[i]) == _name(y[j]) else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    out: list = []
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and _name(x[i]) == _name(y[j]):
            p, q = x[i], y[j]
            out.append([_both(p[0], q[0]), align(p[1], q[1]) if p[1] else None, p[2] if p[2] == q[2] else None])
            i, j = i + 1, j + 1
        elif j == len(y) or (i < len(x) and best[i + 1][j] >= best[i][j + 1]):
            out.append([_both(x[i][0], x[i][0], True), x[i][1], x[i][2]])
            i += 1
        else:
            out.append([_both(y[j][0], y[j][0], True), y[j][1], y[j][2]])
            j += 1
    return {"n": a["n"], "c": _runs(out)}


def slots(wrapper: dict) -> dict:
    """The wrapper with all constant texts turned into slots, its form without wording."""
    return {"n": wrapper["n"], "c": [[k, slots(w) if w else None, None] for k, w, _ in wrapper["c"]]}


def expression(wrapper: dict) -> str:
    """The wrapper as a union-free regular expression."""
    parts = []
    for kind, w, constant in wrapper["c"]:
        e = expression(w) if w else (json.dumps(constant) if constant is not None else TEXT)
        parts.append(f"({e}){kind}" if kind != "1" else e)
    return " ".join([f"<{wrapper['n']}>", *parts, f"</{wrapper['n']}>"]) if parts else f"<{wrapper['n']}/>"


def match(wrapper: dict, node: list, taken=None) -> bool:
    """Whether a construct is of the wrapper's form. A slot holds text and, where ``taken`` is given, trees that it takes by themselves."""
    if node[0] != wrapper["n"]:
        return False
    kids = _children(node)
    reached = {0}
    for kind, w, _ in wrapper["c"]:
        fits = lambda i: i < len(kids) and (match(w, kids[i], taken) if w and is_construct(kids[i]) else w is None and (not is_construct(kids[i]) or bool(taken and taken(kids[i]))))  # noqa: E731, B023
        after = set(reached) if kind in "?*" else set()
        for i in reached:
            n = i
            while fits(n):
                n += 1
                after.add(n)
                if kind in "1?" and w is not None:
                    break
        reached = after
        if not reached:
            return False
    return len(kids) in reached


def forms(parts: list) -> set[tuple[str, str]]:
    """(name, form) of every tree of a text, however deep, and the same under its family."""
    found: set[tuple[str, str]] = set()
    todo = [p for p in parts if not isinstance(p, str)]
    while todo:
        n = todo.pop()
        todo += [c for c in n[1] if not isinstance(c, str)]
        form = slots(generalise(n))
        for name in {n[0], family(n[0])} if is_construct(n) else {n[0]}:
            found.add((name, json.dumps(form | {"n": name}, separators=(",", ":"))))
    return found


class Judge:
    """Which trees of a text are markup, by the wrappers of its host's other folds and of all hosts'."""

    def __init__(self, host: dict[str, dict], everywhere: dict[str, dict]) -> None:
        self.host, self.everywhere = host, everywhere

    def __call__(self, node: list) -> dict | None:
        """The wrapper that takes a tree, or None. A lone delimiter is none's: alignment gave it no mirror."""
        if not is_construct(node):
            return None
        shared = family(node[0])
        # as a whole first; else marks inside that have wrappers of their own count as part of a slot
        for taken in (None, self):
            for known, name in ((self.host, node[0]), (self.everywhere, node[0]), (self.host, shared), (self.everywhere, shared)):
                w = known.get(name)
                if w is not None and match(w, [name, *node[1:]], taken):
                    # the groups of a tree that only its family's wrapper takes are its own
                    return generalise(node) if name != node[0] else w if taken is None else align(w, generalise(node))
        return None


def infer(marked: DataFrame) -> DataFrame:
    """host, name, fold, wrapper (JSON), expression, n (texts behind it), of a table of host, fold and forms.

    The wrapper of a fold is aligned over the other folds; fold ``ALL_FOLDS`` stands for all. A fold that is the only one
    to know a name has no wrapper of it. Forms are counted before the shuffle. The
    distinct forms of a host and name are aligned, most frequent first, in as many parts as they need.
    """
    counted = marked.select("host", "fold", F.explode("forms").alias("f")).select("host", "fold", "f.name", "f.form").groupBy("host", "fold", "name", "form").agg(F.count(F.lit(1)).alias("n"))
    every = counted.groupBy("fold", "name", "form").agg(F.sum("n").alias("n")).select(F.lit(EVERYWHERE).alias("host"), "fold", "name", "form", "n")
    rows = counted.unionByName(every)
    sizes = rows.groupBy("host", "name").agg(F.ceil(F.count(F.lit(1)) / FORMS_A_PART).alias("parts"))
    named = rows.join(sizes, ["host", "name"]).withColumn("part", F.pmod(F.xxhash64("form"), F.col("parts")))

    def over(pairs: list[tuple[int, str]]) -> dict:
        (_, first), *rest = sorted(pairs, key=lambda p: (-p[0], p[1]))
        wrapper = json.loads(first)
        for _, form in rest:
            wrapper = align(wrapper, json.loads(form))
        return wrapper

    def merge(table: pa.Table) -> pa.Table:
        n, form = table.column("n").to_pylist(), table.column("form").to_pylist()
        return pa.table({c: table.column(c)[:1] for c in ("host", "name", "fold")} | {"form": [json.dumps(over(list(zip(n, form))), separators=(",", ":"))], "n": pa.array([sum(n)], pa.int64())})

    def leave_out(table: pa.Table) -> pa.Table:
        rows = list(zip(table.column("fold").to_pylist(), table.column("n").to_pylist(), table.column("form").to_pylist()))
        made = []
        for fold in [*sorted({f for f, *_ in rows}), ALL_FOLDS]:
            others = [(n, form) for f, n, form in rows if f != fold]
            if others:
                w = over(others)
                made.append((fold, json.dumps(w, separators=(",", ":")), expression(w), sum(n for n, _ in others)))
        cut = lambda i, kind: pa.array([m[i] for m in made], kind)
        name = {c: pa.array(table.column(c).to_pylist()[:1] * len(made), pa.string()) for c in ("host", "name")}
        return pa.table(name | {"fold": cut(0, pa.int32()), "wrapper": cut(1, pa.string()), "expression": cut(2, pa.string()), "n": cut(3, pa.int64())})

    parts = named.groupBy("host", "name", "fold", "part").applyInArrow(merge, "host string, name string, fold int, form string, n long")
    return parts.groupBy("host", "name").applyInArrow(leave_out, "host string, name string, fold int, wrapper string, expression string, n long")
