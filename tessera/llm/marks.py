"""Token streams of texts: marks of HTML, Markdown, wiki, LaTeX and reStructuredText, and the text between them.

The lexer knows what a mark looks like, not where markup is: most delimiters are ambiguous, so ``*`` before a word may
open emphasis or belong to ``*args``. ``candidates`` puts an opening and its mirrored closing mark and what stands
between them into one small tree; an opening mark without a mirror is a tree of its own. Which trees are
markup is decided by the wrappers that other texts give (``wrappers``).

A node is [name, children, data, source, sides]: children are strings and nodes, source its text, and sides the opening
and closing marks as they stand there. Regular forms are text: ``- `` and ``1. `` lists, ``| a | b |`` tables, code between lines of three
backticks, formulas between dollar signs.
"""

from __future__ import annotations

import html
import re
from html.entities import html5

#: Element names that count as HTML (or MathML, or the tags of wikis) even without attributes.
ELEMENTS = frozenset(
    """a abbr acronym address article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em
    figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main mark math meta mfrac mi mn mo
    mrow msqrt msub msup mtext nav nowiki ol option p pre q ref s samp script section select small span strike strong style sub summary sup svg table tbody td
    template textarea tfoot th thead time title tr tt u ul var""".split()
)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: LaTeX commands that count without an argument in braces, and font switches.
BARE_COMMANDS = "item|noindent|par|newline|newpage|maketitle|centering|hline|ldots|dots|LaTeX|TeX|bigskip|medskip|smallskip|toprule|midrule|bottomrule"
SWITCHES = "it|bf|em|tt|sc|rm|sf|sl|small|large|Large|footnotesize"
#: Commands whose argument is no text of the document, and those of formulas.
SILENT_COMMANDS = frozenset("cite citep citet ref eqref label footnote pageref index vspace hspace includegraphics bibliography usepackage documentclass".split())
MATH_COMMANDS = frozenset("frac sqrt sum int mathbf mathrm mathcal mathbb binom dfrac tfrac hat bar vec".split())
HEADING_COMMANDS = frozenset("section subsection subsubsection chapter paragraph title".split())

FENCE = re.compile(r"(?ms)^[ \t]*```.*?(?:^[ \t]*```[ \t]*$|\Z)")
_NAME = "(?:" + "|".join(sorted(ELEMENTS | VOID, key=lambda n: (-len(n), n))) + ")"
_QUOTED = r"\"[^\"]*\"|'[^']*'"
_TARGET = r"\((?:[^()\n]|\([^()\n]*\))*\)|\[(?!\s*[-\d:.,\s]*\])[^\[\]\n]+\]"
#: One mark, or one stretch of regular text that looks like marks. Groups are names of ``_LEAVES``, ``_EDGES`` or regular.
_MARK = re.compile(
    rf"""
    (?:(?=[$<&\\~{{}}:`!\[\]'*_])|(?<![^\n]))(?:
    (?P<regular>\$\d[\d.,]*(?=\s|[.,;:!?)]|$) | \$\$.+?\$\$ | \$(?!\s)(?:[^$\n\\]|\\.)+\$ | \[\[\s*[-\d:.,\s]+\]\])
  | (?P<comment><!--.*?-->|<!DOCTYPE[^>]*>|<!\[CDATA\[.*?\]\]>|<\?xml[^>]*\?>)
  | (?P<drop><(?P<dropped>script|style)\b[^>]*>.*?</(?P=dropped)\s*>)
  | (?P<autolink><(?:https?|mailto|ftp):[^<>\s]+>)
  | (?P<tag><(?P<slash>/?)(?P<name>(?i:{_NAME})(?=[\s/>])|(?<=/)[A-Za-z][\w:-]*|[A-Za-z][\w:-]*(?=\s+[\w:-]+\s*=\s*(?:{_QUOTED}))|[A-Za-z][\w:-]*(?=\s*/>))(?:\s(?:[^<>\"']|{_QUOTED})*)?/?>)
  | (?P<entity>&(?:amp;)*(?:\#\d+|\#[xX][0-9a-fA-F]+|(?P<named>[A-Za-z][A-Za-z0-9]+));)
  | (?P<env>\\(?P<edge>begin|end)\{{(?P<envname>[A-Za-z*]+)\}}(?:\[[^\]\n]*\])?(?:(?<=tabular\}})\{{[^}}]*\}})?)
  | (?P<math>\\[()\[\]])
  | (?P<command>~?\\(?P<cmd>[A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{{)
  | (?P<switch>\{{\\(?P<switched>{SWITCHES})\b\s*)
  | (?P<bare>\\(?:{BARE_COMMANDS})(?![A-Za-z\\]))
  | (?P<role>:(?P<rolename>[a-zA-Z][\w:+.-]*):`)
  | (?P<literal>``)
  | (?P<tick>`__?(?!\w)|`)
  | (?P<directive>^[ \t]*\.\.[ ](?:(?P<directivename>[\w:.-]+)::|_[^:\n]+:|\|[^|\n]+\|[ ]\w+::)[ \t]*(?P<argument>[^\n]*))
  | (?P<literalblock>(?<=[\w)\].,])::[ \t]*$)
  | (?P<title>^[ \t]*(?P<titletext>[^\s|`>\#=*-][^\n|]*?)[ \t]*\n[ \t]*(?:={{3,}}|-{{3,}}|~{{3,}}|\^{{3,}}|\"{{3,}}|\+{{3,}}|\*{{3,}})[ \t]*$)
  | (?P<rule>^[ \t]*(?:={{4,}}|-{{3,}}|\*{{3,}}|~{{4,}}|_{{3,}})[ \t]*$)
  | (?P<heading>^[ ]{{0,3}}\#{{1,6}}[ \t]+(?P<headingtext>\S[^\n]*?)[ \t]*\#*[ \t]*$)
  | (?P<wikiheading>^[ \t]*(?P<equals>={{2,6}})[ \t]*(?P<wikititle>[^=\n]+?)[ \t]*(?P=equals)[ \t]*$)
  | (?P<task>^(?P<bullet>[ \t]*(?:[-*+]|\d+[.)])[ \t]+)\[[ xX]\](?=\s))
  | (?P<quote>^[ \t]{{0,3}}(?:>[ \t]?)+(?=\S))
  | (?P<wikitable>^[ \t]*\{{\|[^\n]*\n(?P<wikirows>.*?)^[ \t]*\|\}}|^[ \t]*\{{\|[^\n]*|^[ \t]*\|\}}|^[ \t]*\|-+[ \t]*$)
  | (?P<linkdef>^[ ]{{0,3}}\[[^\]\n]+\]:[ \t]+\S+[^\n]*$)
  | (?P<image>!\[(?=[^\]\n]*\](?:\(|\[)))
  | (?P<page>\[\[|\]\])
  | (?P<web>\[(?:https?|ftp)://[^\s\]]+)
  | (?P<bracket>\[|\](?P<target>{_TARGET})?)
  | (?P<template>\{{\{{(?:[A-Z][\w /-]*|[\w-][\w /-]*(?=\|))(?=[|}}])|\}}\}})
  | (?P<brace>[{{}}])
  | (?P<quotes>'{{2,5}})
  | (?P<waves>(?<!~)~~(?!~))
  | (?P<stars>\*{{1,3}})
  | (?P<lines>__?)
    )""",
    re.X | re.M | re.S,
)
#: Delimiters that are open to the end of their line at most.
_IN_LINE = frozenset("md:* md:** md:*** md:_ md:__ md:~~ md:[ md:![ wiki:[[ wiki:[ wiki:'' wiki:''' wiki:'''' wiki:''''' rst:``".split())


def _entity(m):
    return None if m["named"] and f"{m['named']};" not in html5 else ["html:&", [], html.unescape(html.unescape(m[0]))]


def _wiki_table(m):
    if m["wikirows"] is None:
        return ["wiki:" + m[0].strip()[:2], [], ""]
    rows = []
    for line in re.split(r"(?m)^[ \t]*\|-[^\n]*$", m["wikirows"]):
        cells = [c.strip() for part in re.split(r"(?m)^[ \t]*[|!]\+?", line) for c in re.split(r"\|\||!!", part)]
        rows.append(node("wiki:row", [node("wiki:cell", candidates(c), "", c) for c in cells if c], "", line))
    return ["wiki:table", [r for r in rows if r[1]], ""]


#: Marks that are whole: group of ``_MARK`` to [name, children, data], or None if it is text after all.
_LEAVES = {
    "comment": lambda m: ["html:!", [], ""],
    "drop": lambda m: [f"html:{m['dropped'].lower()}", [], ""],
    "autolink": lambda m: ["md:autolink", [], m[0][1:-1]],
    "entity": _entity,
    "bare": lambda m: [f"latex:{m[0][1:]}/", [], ""],
    "directive": lambda m: [f"rst:..{m['directivename'] or 'target'}", [], (m["argument"] or "").strip()],
    "literalblock": lambda m: ["rst:::", [], ""],
    "title": lambda m: None if m["titletext"].lstrip().startswith(("-", "|")) else ["rst:title", candidates(m["titletext"]), ""],
    "rule": lambda m: ["rst:rule", [], ""],
    "heading": lambda m: ["md:heading", candidates(m["headingtext"]), ""],
    "wikiheading": lambda m: ["wiki:heading", candidates(m["wikititle"]), ""],
    "task": lambda m: ["md:task", [], m["bullet"]],
    "quote": lambda m: ["md:>", [], ""],
    "wikitable": _wiki_table,
    "linkdef": lambda m: ["md:linkdef", [], ""],
}
#: The text of a line that is marked as a whole.
_INNER = {"title": "titletext", "heading": "headingtext", "wikiheading": "wikititle"}


def _flanks(m) -> tuple[bool, bool]:
    """Whether a run of signs can open (what follows is no blank) and close (what precedes is none)."""
    before, after, sign = _before(m), m.string[m.end() : m.end() + 1], m[0][0]
    glued = lambda c: sign in "*_" and (c.isalnum() or c == "_")
    opens = not after.isspace() and after not in ("", sign) and before not in (sign, "\\") and not glued(before)
    closes = not before.isspace() and before not in ("", sign) and after != sign and not glued(after)
    return opens, closes


def _before(m) -> str:
    """The character before a mark, or nothing."""
    return m.string[max(0, m.start() - 1) : m.start()]


def _edges(m, kind: str) -> tuple[str, bool, bool] | None:
    """(mirror: what an opening and its closing mark have in common, can open, can close) of a delimiter; None for text."""
    t = m[0]
    if kind == "tag":
        return _tag(m)
    if kind == "env":
        return f"latex:env:{m['envname']}", m["edge"] == "begin", m["edge"] == "end"
    if kind == "math":
        return "latex:" + ("(" if t[1] in "()" else "["), t[1] in "([", t[1] in ")]"
    if kind in ("command", "switch"):
        return "latex:{", True, False
    if kind == "brace":
        return "{", t == "{", t == "}"
    if kind == "role":
        return "rst:`", True, False
    if kind == "tick":
        return "rst:`", t == "`" and not _before(m).isalnum(), not _before(m).isspace() and _before(m) != ""
    if kind == "page":
        return "wiki:[[", t == "[[" and not _index(m), t == "]]"
    if kind in ("image", "web"):
        return "md:[", True, False
    if kind == "bracket":
        return "md:[", t == "[", t != "["
    if kind == "template":
        return "wiki:{{", t != "}}", t == "}}"
    if kind == "literal":
        return "rst:``", True, True
    return ("wiki:" if kind == "quotes" else "md:") + t, *_flanks(m)


def _index(m) -> bool:
    """Whether a bracket follows what it may be an index of."""
    return re.match(r"[\w\])\[]", _before(m)) is not None


def _tag(m) -> tuple[str, bool, bool] | None:
    name = m["name"].lower()
    if m["slash"]:
        return f"html:{name}", False, True
    bare = m[0].strip("</>") == m["name"]
    if bare and m["name"] not in ELEMENTS | VOID and not m["name"].isupper() and not m[0].endswith("/>"):
        return None
    if bare and re.search(r"\b[A-Z]\w*$", m.string[max(0, m.start() - 40) : m.start()]) and f"</{name}" not in m.string[m.end() :].lower():
        return None  # a type's parameter
    return f"html:{name}", True, name in VOID or m[0].endswith("/>")


#: Elements whose end may be left out; what follows is theirs up to the next of the kind.
_IMPLIED = frozenset("html:li/ html:tr/ html:td/ html:th/ html:dt/ html:dd/ latex:item/".split())
#: Marks open at a time. Tags beyond that stand alone, as those without an end do; other delimiters beyond it are text.
DEEP = 100


def _adopted(kids: list) -> list:
    """Items without an end take what follows them, up to the next item."""
    if not any(not isinstance(k, str) and k[0] in _IMPLIED for k in kids):
        return kids
    out: list = []
    owner = None
    for k in kids:
        name = "" if isinstance(k, str) else k[0]
        if name in _IMPLIED:
            owner = [name[:-1], [], k[2], k[3], k[4]]
            out.append(owner)
        elif owner is not None and name != owner[0]:
            owner[1].append(k)
        else:
            owner = None
            out.append(k)
    return out


def node(name: str, children: list, data: str, source: str, sides: tuple[str, str] = ("", "")) -> list:
    return [name, children, data, source, sides]


class _Open:
    """A delimiter that waits for its mirror, and what came after it."""

    __slots__ = ("kind", "match", "mirror", "parts", "before", "resumes")

    def __init__(self, kind, match, mirror):
        # before: the arguments of a command before the one that is read; resumes: where the next one's brace stands
        self.kind, self.match, self.mirror, self.parts, self.before, self.resumes = kind, match, mirror, [], [], -1


def _alone(o: _Open) -> list:
    """An opening mark without its mirror. Tags and edges of environments are marks by themselves, others a lone delimiter."""
    name = f"{o.mirror}/" if o.kind in ("tag", "env") else f"{o.mirror} alone"
    return node(name, [], "", o.match[0], (o.match[0], ""))


def _whole(o: _Open, end) -> list | None:
    """The tree of an opening mark, its mirror and what is between; None if the two don't belong together."""
    text, kind, kids = o.match.string, o.kind, o.parts
    inner, source = text[o.match.end() : end.start()], text[o.match.start() : end.end()]
    name, data = o.mirror, ""
    if kind == "math":
        name, kids, data = "latex:math", [], inner.strip()
    elif kind == "switch":
        name = f"latex:{o.match['switched']}"
    elif kind == "command":
        cmd = o.match["cmd"]
        name = f"latex:{cmd}"
        if cmd in MATH_COMMANDS:
            name, kids, data = "latex:math", [], source.lstrip("~")
        elif cmd in SILENT_COMMANDS:
            kids = []
        elif cmd in HEADING_COMMANDS:
            name = "latex:heading"
    elif kind == "brace":
        return None
    elif kind in ("tag", "env"):
        kids = _adopted(kids)
    elif kind == "role":
        math = o.match["rolename"] == "math"
        name, kids, data = ("rst:math", [], inner) if math else ("rst:role", [re.sub(r"\s*<[^>]*>$", "", inner).lstrip("~!")], "")
    elif kind == "tick":
        if not end[0].endswith("_") or ("\n" in inner and "<" not in inner):
            return None
        name, kids = "rst:link", candidates(re.sub(r"\s*<[^>]*>$", "", inner).strip())
    elif kind == "literal":
        name, kids = "rst:literal", [inner]
    elif kind == "page":
        name, kids = "wiki:link", _last_part(kids)
    elif kind == "template":
        name, kids = "wiki:template", _last_part(kids) if "|" in inner else []
    elif kind == "web":
        if end["target"]:
            return None
        name, kids = "wiki:extlink", [inner.strip()]
    elif kind in ("image", "bracket"):
        if not end["target"] or (kind == "bracket" and _index(o.match)):
            return None
        name = "md:image" if kind == "image" else "md:link"
    elif kind == "lines" and not re.search(r"[^\w\n]", inner):
        return None  # an identifier
    return node(name, kids, data, source, (o.match[0], end[0]))


def _last_part(kids: list) -> list:
    """What stands after the last bar."""
    for i in range(len(kids) - 1, -1, -1):
        if isinstance(kids[i], str) and "|" in kids[i]:
            return [kids[i].rpartition("|")[2], *kids[i + 1 :]]
    return kids


def candidates(text: str) -> list:
    """The text as a list of strings and trees. However deep marks are nested, each is met once on a stack."""
    stack: list[_Open] = [_Open("", None, "")]
    at = 0

    def say(part) -> None:
        if part != "":
            stack[-1].parts.append(part)

    def give_up(n: int) -> None:
        """Delimiters from the n-th on stand alone; what they held is their parents'."""
        while len(stack) > n:
            o = stack.pop()
            say(o.match[0] if o.kind in ("brace", "bracket", "tick") else _alone(o))
            stack[-1].parts.extend([*o.before, *o.parts])

    def plain(until: int) -> None:
        """Text up to a place; delimiters of a line are given up at its end."""
        nonlocal at
        while at < until:
            end = text.find("\n", at, until)
            if end >= 0 and any(o.mirror in _IN_LINE for o in stack[1:]):
                say(text[at:end])
                give_up(next(i for i, o in enumerate(stack) if o.mirror in _IN_LINE))
                at = end
                say("\n")
                at += 1
            else:
                say(text[at:until])
                at = until

    for m in _marks(text):
        kind = m.lastgroup
        plain(m.start())
        at = m.end()
        if kind in _LEAVES:
            leaf = _LEAVES[kind](m)
            inner = _INNER.get(kind)
            sides = (text[m.start() : m.start(inner)], text[m.end(inner) : m.end()]) if inner else (m[0], "")
            say(node(*leaf, m[0], sides) if leaf else m[0])
            continue
        mirror, opens, closes = _edges(m, kind) or ("", False, False)
        if kind == "brace" and stack[-1].resumes == m.start():
            continue
        if kind == "tag" and opens and closes:
            say(node(f"{mirror}/", [], "", m[0], (m[0], "")))
            continue
        family = ("{", "latex:{") if mirror == "{" else (mirror,)
        deep = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].mirror in family), 0) if closes else 0
        if deep:
            give_up(deep + 1)
            o = stack[-1]
            if o.kind == "command" and text[m.end() : m.end() + 1] == "{":
                o.before, o.parts, o.resumes = [*o.before, *o.parts, "}{"], [], m.end()
                continue
            stack.pop()
            whole = _whole(o, m)
            for part in [whole] if whole is not None else [o.match[0], *o.before, *o.parts, m[0]]:
                say(part)
        elif opens and len(stack) < DEEP:
            stack.append(_Open(kind, m, mirror))
        elif opens and kind in ("tag", "env"):
            say(_alone(_Open(kind, m, mirror)))
        elif closes and kind in ("tag", "env"):
            family, _, name = mirror.partition(":")
            say(node(f"{family}:/{name}", [], "", m[0], (m[0], "")))
        else:
            say(m[0])
    plain(len(text))
    give_up(1)
    return stack[0].parts


def _marks(text: str):
    """Matches of marks outside fenced code."""
    at = 0
    for begin, end in [*((m.start(), m.end()) for m in FENCE.finditer(text)), (len(text), len(text))]:
        yield from (m for m in _MARK.finditer(text, at, begin) if m.lastgroup != "regular")
        at = end
