import base64
import json
import random
import re

import tiktoken

from tessera.llm import bpe, marks, markup, packing, rankfusion, splitting, subjects, wrappers


def col(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


TEXTS = [None, "", " ", "Hello world", "don't I'LL\r\n\r\n x", "naïve 日本語 👍🏽 \x00\x01", "<|endoftext|> <s> <unk>", "a" * 30000, " " * 500, "\u2581 a\u2581b", "Hello world", "x" * 50 + "1234567 !!??"]


def test_ids_equal_tiktoken(spark):
    """Ids are those of the rank file run by another library; decoding gives the text back."""
    ranks = {}
    with open(f"{bpe.TOKENIZER_DIR}/byte_bpe_50k.tiktoken", "rb") as f:
        for line in f:
            t, r = line.split()
            ranks[base64.b64decode(t)] = int(r)
    other = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(df).collect()}
    assert got == {i: other.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(df)).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df).collect()} == {i: len(x) for i, x in got.items()}
    assert bpe.encode(df.limit(0)).count() == 0


def test_plan_packs_all():
    """Every item gets one slot, no container overflows, and the space is well used."""
    r = random.Random(1)
    for capacity, n in ((10, 50), (100, 3000), (2048, 20000)):
        h = {}
        for _ in range(n):
            x = min(capacity, 1 + int(r.expovariate(6 / capacity)))
            h[x] = h.get(x, 0) + 1
        bins = packing.plan(h, capacity)
        held = {}
        for b in bins:
            assert sum(x * k for x, k in b.holds) + b.left == capacity and b.left >= 0 and b.count > 0
            for x, k in b.holds:
                held[x] = held.get(x, 0) + k * b.count
        assert held == h and len(bins) <= 3 * len(h)
        total, used = sum(x * k for x, k in h.items()), sum(b.count for b in bins)
        assert used <= total / capacity * 1.05 + 1
    assert packing.plan({}, 5) == []


def test_pack(spark):
    r = random.Random(2)
    rows = [(i, " ".join(["word"] * r.choice([0, 1, 3, 3, 3, 50, 130]))) for i in range(300)] + [(900, None), (901, "word " * 1000), (None, "word"), (7, "word word"), (7, "word word")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, rank int")
    got = packing.pack(df, capacity=128).collect()
    use = {}
    for x in got:
        use[x["container_id"]] = use.get(x["container_id"], 0) + x["n_tokens"]
    assert max(use.values()) <= 128 and sorted(use) == list(range(len(use)))
    tokens = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df.where("doc_id <> 7 OR doc_id IS NULL")).collect()}
    by = {}
    for x in got:
        by.setdefault(x["doc_id"], []).append((x["piece_no"], x["token_start"], x["n_tokens"]))
    for i, n in tokens.items():
        pieces = sorted(by.pop(i, []))
        assert sum(p[2] for p in pieces) == n and [p[0] for p in pieces] == list(range(len(pieces)))
        assert len(pieces) == -(-n // 128) and all(p[2] == 128 for p in pieces[:-1])
    assert len(by.pop(7)) == len([1 for i, _ in rows if i == 7]) and not by
    f = packing.fill(packing.pack(df, capacity=128), 128).first()
    assert f["n_items"] == len(got) and f["used_share"] > 0.9
    assert packing.pack(df.limit(0)).count() == 0


RANK = "system string, query_id string, rank int, chunk_id string, score double"


def test_fusion_by_hand(spark):
    """Direction, best of repeats, unknown chunks and systems, nulls, ties and missing places."""
    rows = [
        ("up", "q", None, "a", 3.0), ("up", "q", None, "b", 2.0), ("up", "q", None, "a", 1.0), ("up", "q", None, "c", None), ("up", "q", None, "zz", 9.0), ("up", "q", None, "d", float("nan")),
        ("down", "q", None, "b", -1e9), ("down", "q", None, "c", 5.0), ("down", "q", None, "d", 5.0), ("else", "q", None, "a", 1.0), ("up", None, None, "a", 1.0), ("up", "q", None, None, 1.0),
    ]
    lists = rankfusion.counted_lists(spark.createDataFrame(rows, RANK), spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("d",), (None,)], "chunk_id string"), spark.createDataFrame([("up", True), ("down", False), ("down", False), ("none", None)], "system string, higher_is_better boolean"))
    got = {r["chunk_id"]: r for r in rankfusion.fuse(lists).collect()}
    assert {c: r["mean_place"] for c, r in got.items()} == {"a": (1 + 4) / 2, "b": (2 + 1) / 2, "c": (3 + 2) / 2, "d": (3 + 2) / 2}
    assert abs(got["b"]["score"] - (1 / 62 + 1 / 61)) < 1e-12 and got["c"]["ranks"] == {"down": 2} and got["a"]["n_lists"] == 2
    assert col(rankfusion.lowest_mean_place(lists), "chunk_id", "rank") == [("a", 2), ("b", 1), ("c", 3)]
    assert rankfusion.fuse(lists.limit(0)).count() == 0


def test_fusion_equals_brute_force(spark):
    r = random.Random(3)
    rows = [(s, f"q{q}", None, f"c{c:02d}", r.gauss(0, 1) * scale) for q in range(6) for s, scale in (("up", 1e6), ("down", 1e-3), ("more", 1.0)) for c in range(25) if r.random() < 0.8]
    up = {"up": True, "down": False, "more": True}
    lists = rankfusion.counted_lists(spark.createDataFrame(rows, RANK), spark.createDataFrame([(f"c{c:02d}",) for c in range(25)], "chunk_id string"), spark.createDataFrame(list(up.items()), "system string, higher_is_better boolean"))
    want = []
    for q in range(6):
        place: dict = {}
        for s in up:
            ranked = [c for _, c in sorted((-x if up[s] else x, c) for t, n, _, c, x in rows if t == s and n == f"q{q}")]
            for c in {c for _, n, _, c, _ in rows if n == f"q{q}"}:
                place.setdefault(c, []).append(ranked.index(c) + 1 if c in ranked else len(ranked) + 1)
        k = 2 * 3 * 27 * 27
        want += [(f"q{q}", c) for c in sorted(place, key=lambda c: (sum(place[c]), -sum(1 / (k + p) for p in place[c]), c))[:3]]
    assert col(rankfusion.lowest_mean_place(lists), "query_id", "chunk_id") == sorted(want)


def check_pieces(text, limit, overlap):
    w = re.findall("[^ \t\n\r]+", text)
    pieces = splitting.cuts(text, limit, overlap)
    done = 0
    for no, (a, b, first, last, how) in enumerate(pieces):
        assert re.findall("[^ \t\n\r]+", text[a:b]) == w[first:last] and last - first <= limit
        assert first == (max(0, done - overlap) if no else 0) and last > done
        done = last
    assert done == len(w) and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    return pieces


def test_split(spark):
    """Pieces cover the text, stay under the limit, overlap as asked, and end at boundaries where there are any."""
    r = random.Random(4)
    topic = lambda t, n: " ".join(" ".join(f"{t}{r.randrange(12)}" for _ in range(9)) + "." for _ in range(n))
    text = topic("cat", 40) + "\n\n" + topic("sea", 45) + "\n\n- " + "\n- ".join(topic("list", 1) for _ in range(30)) + "\n\n```python\n" + "\n".join(f"x{i} = {i}" for i in range(200)) + "\n```\n| a | b |\n" + "\n".join("| 1 | 2 |" for _ in range(80))
    pieces = check_pieces(text, 512, 40)
    assert all(p[4] != "forced" for p in pieces)
    first_end = pieces[0][1]
    assert text[first_end : first_end + 2] == "\n\n"  # the change of topic
    check_pieces("word " * 3000, 512, 40)
    check_pieces("\u00a0x" * 600 + " y" * 600, 512, 40)
    check_pieces("a. " * 700, 5, 4)
    assert len(splitting.cuts("a " * 512)) == 1
    rows = [("c1", ["h"], text), ("c2", None, "short"), ("c3", None, None), ("c4", [], ""), (None, ["n"], "w " * 600), ("c1", ["h"], text)]
    df = spark.createDataFrame([(i, h, t, 5) for i, h, t in rows], "chunk_id string, heading_path array<string>, text string, n_words int")
    got = splitting.split(df).collect()
    assert {x["chunk_id"] for x in got} == {"c1", None} and all(x["n_words"] <= 512 for x in got)
    assert len([x for x in got if x["chunk_id"] == "c1"]) == 2 * len(pieces) and all(x["heading_path"] == ["h"] for x in got if x["chunk_id"])
    assert splitting.split(df.limit(0)).count() == 0


PLAIN = [
    "It takes *args and **kwargs, then **options of the clip.", "The cost is 3 * n * k plus 2 * m steps.", "Select with data[[0, 3]] and leave __init__ alone.", "The cache lies in C:\\loom\\temp\\kata and lines end in \\n.",
    "A placeholder such as {meze} or {0:>8} is filled later.", "Arrows like a -> b, a <- b or <20 ms are plain signs.", "Issue #5545 asked whether zi == veni & vo holds.", "The type is Tensor<float> or List<Sazo> in the C++ headers.",
    "It holds while li < nuve and bo > 38 for all rows.", "A budget of $54 or $37 per run is typical; R&D pays.", "The set is {x_1, x_2, ..., x_42} and its size a^b.", "- a: b\n  - c: d\n1. e", "| a | b |\n| c | d |", "```python\nx = '<b>y</b>' # **z**\n```",
    "The value is $\\mathbf{v} = \\alpha x^{3}$ here.\n\n$$\\frac{a}{b}$$", "loom.x(a, b=1) -> Tensor", "snake_case_name and _private or obj._x", "", "a[0][1] and b(c)[d]",
]
MARKED = {
    "the <b>bold</b> word": "the bold word", "a <!-- note --> b": "a b", "x &amp;quot;y&amp;quot; &#8220;z&#x201D;": "x \"y\" “z”", "for every</span> row": "for every row", "<p>entries": "entries", "a<br/>b": "a\nb",
    "<ul>\n<li>one</li>\n<li>two\n</ul>": "- one\n- two", "<TABLE><TR><TD>a</TD><TD>38</TD></TR></TABLE>": "| a | 38 |", "<pre><code class=python>x = 1</code></pre>": "```\nx = 1\n```", "a <script>f()</script>b": "a b", "an <img src=\"a.png\" alt=\"x\"> b": "an b",
    "<sup\n class='voli'>the</sup> end": "the end", "<h2 id=\"x\">Head</h2>": "Head", "<math><mi>x</mi><mo>=</mo><mn>9</mn></math>": "$x=9$",
    "### Head\ntext": "Head\n\ntext", "a *b* **c d** ***e*** f": "a b c d e f", "is __for every__ frame": "is for every frame", "a ~~b~~ c": "a b c", "[a b](../c.md) [d][e] ![f g](h.svg)": "a b d f g", "> q\n> r": "q\nr", "- [x] a\n- [ ] b": "- a\n- b",
    "[[Loss]] [[Page|text]] [[File:a.png|thumb|cap]]": "Loss text cap", "'''a''' ''b c'' {{Note|d}}": "a b c d", "== Head ==\nx": "Head\n\nx", "{| class=\"wikitable\"\n|-\n| a || 10\n|}": "| a | 10 |",
    "\\emph{a} \\textbf{b}~\\cite{c} {\\it d} e\\footnote{f}": "a b d e", "\\section{H}": "H", "\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}": "- a\n- b", "a \\(x^2\\) b \\[ y \\leq 4 \\] \\frac{x}{4}": "a $x^2$ b $y \\leq 4$ $\\frac{x}{4}$",
    ":class:`~loom.x` :math:`z_t` `text <u.html>`_": "loom.x $z_t$ text", "Title\n=====\ntext": "Title\n\ntext", ".. math:: x = v_0\ny": "$x = v_0$\n\ny", "a::\n\n.. code-block:: python\n\n   x = 1": "a\n\n   x = 1", "for x\n.. note::\n   mind": "for x\n\n   mind",
}


def trees(text):
    return [p for p in marks.candidates(text) if wrappers.is_construct(p)]


def own_judge(*texts):
    """A judge with the wrappers of these texts."""
    known: dict = {}
    for t in texts:
        for name, form in wrappers.forms(marks.candidates(t)):
            w = json.loads(form)
            known[name] = wrappers.align(known[name], w) if name in known else w
    return wrappers.Judge(known, {})


def test_marks_by_hand():
    for t in PLAIN:
        assert not trees(t), t
    for t, want in MARKED.items():
        judge, parts = own_judge(t), marks.candidates(t)
        assert trees(t) and all(judge(c) is not None for c in trees(t)), t
        assert markup.tidy(markup.render(parts, judge)) == want, t
    assert not any(own_judge(t)(n) for t in PLAIN for n in marks.candidates(t) if not isinstance(n, str))


def test_deep_marks():
    """However deep tags are nested, all are found and none is left."""
    text = "<div>" * 5000 + "x" + "</div>" * 4000
    judge = own_judge(text)
    assert markup.render(marks.candidates(text), judge).strip() == "x"
    assert marks.candidates("{" * 3000 + "[" * 3000)


def test_wrappers_decide():
    """Without a wrapper of another text nothing is markup; with one, texts that it never saw are."""
    unseen = "a <ul><li>x</li><li>y <b>z</b></li></ul> b"
    assert markup.render(marks.candidates(unseen), wrappers.Judge({}, {})) == unseen
    one, two = "<ul><li>p</li></ul>", "<ul><li>p</li><li>q</li></ul>\nthe <b>r</b>"
    assert markup.render(marks.candidates(unseen), own_judge(one, two)) == "a \n- x\n- y z\n b"
    assert markup.render(marks.candidates(unseen), own_judge("<b>q</b>")) == "a \n- x\n- y z\n b"  # by the family of elements with a slot
    assert markup.render(marks.candidates(unseen), own_judge("<br>")) == unseen
    assert markup.render(marks.candidates("take *args, **kw of it"), own_judge("so *a b* c", "so **a b** c")) == "take *args, **kw of it"


def test_wrapper_inference():
    """Different texts become slots, what one lacks is optional, alike neighbours repeat; a wrapper takes all it came from."""
    found = [trees(t)[0] for t in ("<ul><li>a</li></ul>", "<ul><li>b <b>c</b></li><li>d</li></ul>", "<ul>x<li>a</li></ul>")]
    w = wrappers.generalise(found[0])
    assert wrappers.expression(w) == '<html:ul> <html:li> "a" </html:li> </html:ul>'
    for t in found[1:]:
        w = wrappers.align(w, wrappers.generalise(t))
    assert wrappers.expression(w) == '<html:ul> ("x")? (<html:li> #TEXT (<html:b> "c" </html:b>)? </html:li>)+ </html:ul>'
    assert all(wrappers.match(w, t) for t in found)
    assert not wrappers.match(w, trees("<ul><b>x</b></ul>")[0])


def test_clean(spark):
    """Each form stands in several texts of a host; the clean text of each is made with wrappers of the others. Plain texts give no rows."""
    tail = lambda i, t: f"{t}\n\nWords number {i}."
    rows = [(f"m{i}-{j}", "https://H0.example/a", tail(j, t)) for i, t in enumerate(MARKED) for j in range(4)] + [(f"p{i}", "https://h0.example", t) for i, t in enumerate(PLAIN)]
    rows += [("n", "https://h.example", None), ("m0-0", "https://H0.example/a", tail(0, next(iter(MARKED)))), ("z", None, "the <b>x</b>"), (None, "https://h0.example", "all of <b>it</b>")]
    df = spark.createDataFrame([(i, u, t, "k", 3) for i, u, t in rows], "chunk_id string, url string, text string, host string, salt int")
    got = {(x["chunk_id"], x["clean_text"]) for x in markup.clean(df, ["chunk_id"]).collect()}
    want = {(f"m{i}-{j}", markup.tidy(tail(j, w))) for i, w in enumerate(MARKED.values()) for j in range(4)} | {("z", "the x"), (None, "all of it")}
    assert got == want, got ^ want
    assert markup.clean(df.limit(0), ["chunk_id"]).count() == 0
    inferred = markup.infer(markup.marked(df, ["chunk_id"]))
    assert inferred.where("host = 'h0.example' AND fold >= 0").count() > 5
    alone = df.where("chunk_id = 'z'")
    assert markup.clean(alone, ["chunk_id"]).count() == 0  # no other text vouches for it


WORDS = {
    "law": "court judge statute verdict jury appeal".split(), "sport": "goal referee stadium striker league medal".split(), "music": "violin chord melody tempo sonata choir".split(),
    "farming": "harvest tractor field barn plough seed".split(), "cooking": "oven dough recipe butter pan spice".split(),
}
SUBJECTS = [(s, "d", w[:2]) for s, w in WORDS.items()] + [("empty", None, None), (None, "x", ["y"])]


def sentence(r, s):
    a, b, c = r.sample(WORDS[s], 3)
    return r.choice([f"The {a} meets a {b} before the {c}.", f"Why does a {a} matter to the {b}?", f"We model the {a} with {r.randrange(99)} rows per {c}."])


def test_subjects(spark):
    """A fifth of the prose sentences makes a subject; headings, lists, tables, code and formulas don't count; held-out accuracy."""
    r = random.Random(5)
    neutral = lambda: r.choice(["Read the note twice.", "See the list below.", "Skip this page if it is known."])
    docs, truth = [], {}
    for i in range(240):
        main, other = r.sample(list(WORDS), 2)
        n = r.randint(0, 3)
        body = [sentence(r, main) for _ in range(8)] + [sentence(r, other) for _ in range(n)] + [neutral() for _ in range(3)]
        r.shuffle(body)
        docs.append((i, " ".join(body)))
        truth[i] = {main} | ({other} if n / 11 >= 0.2 or n / (8 + n + 3) >= 0.2 else set())
    docs += [(900, None), (901, ""), (902, " \n"), (903, "# court judge\n- goal: referee\n| court | jury |\n```\ngoal referee.\n```\n$court$"), (904, docs[0][1]), (905, "Read the note twice.")]
    labels = [(i, f" {next(iter(truth[i])).upper()}", "r") for i in range(0, 120, 2)] + [(1, None, "r"), (3, "nonsense", "r"), (None, "law", "r")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, subject string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string, rater string")
    sub = spark.createDataFrame(SUBJECTS, "subject string, description string, seed_terms array<string>")
    got: dict = {}
    for x in subjects.subjects_of(d, lab, sub).collect():
        got.setdefault(x["doc_id"], set()).add(x["subject"])
    assert not got.keys() & {900, 901, 902, 903, 905} and got[904] == got[0]
    assert sum(got.get(i) == truth[i] for i in range(120, 240)) >= 0.95 * 120
    assert subjects.subjects_of(d, lab.limit(0), sub).where("doc_id < 240").count() > 0
    assert subjects.subjects_of(d.limit(0), lab, sub).count() == 0 and subjects.subjects_of(d, lab, sub.limit(0)).count() == 0


def test_sentences():
    assert subjects.sentences("Title line\nOne two. Three? ¿Por qué? Loom.nn.x is one!\n- item one.\n```\ncode.\n```\nLast") == [["one", "two"], ["three"], ["por", "qué"], ["loom", "nn", "x", "is", "one"]]


def test_queries_run(spark, small):
    from tessera.llm import queries as q

    assert set(q.oracle_sql()) <= set(q.queries())
    for name in ("p6_found", "p9_composition"):
        assert q.queries()[name](spark, small).count() >= 0
