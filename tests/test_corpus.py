from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import chunking as C
from tessera.operators import quality, snapshots, upsert
from tessera.plans.ranking import place_by_key, position_by_bucket
from tessera.sources import files, web
from tessera.streaming.corpus import read_corpus, upsert_stream

SNAP = "snapshot_id string, chunk_id string, content_hash string, fetched_at string, loaded_at timestamp"


def col(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_snapshot_changes(spark):
    """Spelling of ids and hashes, the latest instant, unknown hashes, null ids and late rows."""
    data = [
        ("1", "A ", "sha256:00000000000000AA", "2031-01-01T00:00:00Z", None), ("1", "b", "bb", None, None), ("1", "c", "cc", "x", None), ("1", None, "zz", None, None), ("1", "e", None, None, None),
        ("2", "a", "00000000000000aa ", "2031-02-01T00:00:00Z", None), ("2", "b", "b1", "2031-02-01T01:00:00+02:00", None), ("2", "B", "b2", "2031-01-31T23:30:00Z", None), ("2", "d", "dd", None, None), ("2", "e", "ee", None, None),
    ]
    df = spark.createDataFrame(data, SNAP).withColumn("_n", F.lit(1)).withColumn("hash", F.lit("x"))
    want = [("2", "b", "changed"), ("2", "c", "removed"), ("2", "d", "added")]
    assert col(snapshots.snapshot_changes(df), "snapshot_id", "chunk_id", "change_kind") == want
    assert col(snapshots.snapshot_changes(df.union(df), chunk_rows=1), "snapshot_id", "chunk_id", "change_kind") == want
    assert snapshots.snapshot_changes(df.limit(0)).count() == 0


def test_snapshot_chunks_discard(spark):
    """Chunks of any size give the same changes as a plain comparison."""
    rows = [(s, f"k{i:04d}", f"h{i if s == '1' or i % 37 else -i}", None, None) for s in "12" for i in range(500) if not (s == "2" and i % 101 == 0)]
    df = spark.createDataFrame(rows, SNAP)
    want = sorted([("2", f"k{i:04d}", "removed") for i in range(500) if i % 101 == 0] + [("2", f"k{i:04d}", "changed") for i in range(1, 500) if i % 37 == 0 and i % 101])
    for n in (1, 8, 1000):
        assert col(snapshots.snapshot_changes(df, n), "snapshot_id", "chunk_id", "change_kind") == want


def test_ranking_helpers(spark):
    df = spark.createDataFrame([("g", i, float(i // 2)) for i in range(100)] + [("h", 1, 1.0), (None, 5, 2.0)], "g string, i int, k double")
    placed = {(r["g"], r["i"]): (r["place"], r["list_size"]) for r in place_by_key(df, ["g"], "k").collect()}
    assert placed[("g", 0)] == placed[("g", 1)] == (1, 100) and placed[("g", 99)] == (99, 100) and placed[("h", 1)] == (1, 1)
    numbered = position_by_bucket(df, ["g"], ["i"], "n", buckets=3).collect()
    assert sorted(r["n"] for r in numbered if r["g"] == "g") == list(range(100)) and [r["n"] for r in numbered if r["g"] is None] == [0]


def _chunk(i, url, text, n=100, ordinal=0, path=("h",)):
    return (i, url, "", f"t {url}", list(path), ordinal, text, n, X and f"h{i}")


CH = "chunk_id string, url string, anchor string, title string, heading_path array<string>, ordinal int, text string, n_tokens int, content_hash string"
B = "https://x.example/stable/generated/"


def test_alias_rules(spark):
    pairs = [("a.nn.Linear.html", "a.nn.modules.Linear.html", True), ("a.cuda.f.html", "a.xpu.f.html", False), ("a.f.html", "b.g.html", False), ("a.f_class.html", "a.f.html", True)]
    df = spark.createDataFrame([(B + a, B + b, w) for a, b, w in pairs], "a string, b string, w boolean")
    assert all(r["got"] == r["w"] for r in df.withColumn("got", X.alias_compatible("a", "b")).collect())
    assert quality.first_fit([B + "a.cuda.f.html", B + "a.f.html", B + "a.xpu.f.html"]) == [[B + "a.cuda.f.html"], [B + "a.f.html"], [B + "a.xpu.f.html"]]


def test_quality(spark):
    u = [B + "loom.nn.X.html", B + "loom.nn.modules.X.html", B + "loom.cuda.X.html", B + "old.html", B + "other.html"]
    data = [_chunk("1", u[0], "use loom.nn.X now"), _chunk("2", u[1], "use loom.nn.modules.X now"), _chunk("3", u[2], "use loom.cuda.X now"), _chunk("4", u[3], "This was deprecated.", 5), _chunk("5", u[4], "words"), _chunk("5", u[4], "words")]
    chunks = spark.createDataFrame(data, CH)
    a = {r["url"]: (r["canonical_url"], r["status"]) for r in quality.analyze(chunks).collect()}
    assert a == {u[0]: (u[0], "ok"), u[1]: (u[0], "ok"), u[2]: (u[2], "ok"), u[3]: (u[3], "stub"), u[4]: (u[4], "ok")}
    r = quality.report(quality.analyze(chunks)).first()
    assert (r["n_alias_pages"], r["n_groups"], r["n_redundant"], r["n_stubs"]) == (2, 1, 1, 1)
    assert quality.text_only_collisions(quality.alias_clusters(quality.page_texts(chunks.where("chunk_id IN ('1', '2', '5')")))).first()[0] == 0
    pages = spark.createDataFrame([(x, "t", "docs", "1", "", 1, "", "ok") for x in u], "url string, title string, source string, version string, fetched_at string, n_chunks int, canonical_url string, status string")
    once = quality.apply_quality(pages, quality.analyze(chunks))
    assert col(once, "url", "canonical_url") == col(quality.apply_quality(once, quality.analyze(chunks)), "url", "canonical_url")
    c = quality.quality_counts(once).first()
    assert (c["stubs"], c["redundant"], c["unanalyzed"]) == (1, 1, 0)


def test_upsert(spark):
    """Stale chunks of a delivered page go, others stay, a second load changes nothing, quality survives."""
    none_p, none_c = spark.createDataFrame([], files.CHUNKS).limit(0), spark.createDataFrame([], files.CHUNKS)
    first = spark.createDataFrame([_chunk("c1", "u1", "one"), _chunk("c2", "u1", "two", ordinal=1), _chunk("t1", "u2", "tut")], CH)
    empty_pages = spark.createDataFrame([], "url string, title string, source string, version string, fetched_at string, n_chunks int, canonical_url string, status string")
    one = upsert.load(empty_pages, none_c, first)
    assert one.counts.first().asDict() == {"pages": 2, "chunks": 3, "inserted": 3, "updated": 0, "deleted": 0}
    pages = one.pages.withColumn("status", F.when(F.col("url") == "u1", "stub").otherwise(F.col("status")))
    second = spark.createDataFrame([_chunk("c2", "u1", "TWO", ordinal=1), _chunk("c3", "u1", "three", ordinal=2), _chunk(None, "u1", "x")], CH)
    two = upsert.load(pages, one.chunks, second)
    assert two.counts.first().asDict() == {"pages": 1, "chunks": 2, "inserted": 1, "updated": 1, "deleted": 1}
    assert col(two.chunks, "chunk_id", "text") == [("c2", "TWO"), ("c3", "three"), ("t1", "tut")]
    assert col(two.pages, "url", "status", "n_chunks") == [("u1", "stub", 2), ("u2", "ok", 1)]
    again = upsert.load(two.pages, two.chunks, second)
    assert again.counts.first().asDict() == {"pages": 1, "chunks": 2, "inserted": 0, "updated": 0, "deleted": 0}
    assert none_p.count() == 0


HTML = """<html><head><title>T</title></head><body><nav>menu</nav><article class="bd-article"><section id="top"><h1>Main<a class="headerlink">#</a></h1>
<p>Intro text<p>Second <b>bold</b> text <script>var a = "</p>";</script>
<section id="sub"><h2>Sub</h2><div class="highlight-python"><pre>x = 1
y = 2</pre></div><div class="sphx-glr-script-out"><pre> 10%| bar
done</pre></div><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>
<ul><li>one<ul><li>deep</li></ul></li><li>two</li></ul><div class="admonition note"><p class="admonition-title">Note</p><p>careful</p></div>
<span class="katex"><span class="katex-mathml"><annotation>a^2</annotation></span><span class="katex-html">a2</span></span></section>
<dl class="py function"><dt id="loom.f">loom.f(x)</dt><dd><p>Does it.</p></dd></dl></section></article></body></html>"""


def test_html_blocks():
    title, blocks = C.blocks_of(HTML)
    assert title == "Main"
    got = [(b.kind, b.text, b.path, b.anchor) for b in blocks]
    s = ("Main", "Sub")
    assert got == [
        ("paragraph", "Intro text", ("Main",), "top"), ("paragraph", "Second bold text", ("Main",), "top"), ("code", "```python\nx = 1\ny = 2\n```", s, "sub"), ("code", "Out:\n```\ndone\n```", s, "sub"), ("table", "| a | b |\n| 1 | 2 |", s, "sub"),
        ("list", "- one", s, "sub"), ("list", "  - deep", s, "sub"), ("list", "- two", s, "sub"), ("paragraph", "Note: careful", s, "sub"), ("paragraph", "$a^2$", s, "sub"),
        ("signature", "loom.f(x)", ("Main", "Sub", "loom.f"), "loom.f"), ("paragraph", "Does it.", ("Main", "Sub", "loom.f"), "loom.f"),
    ]
    assert C.blocks_of(None) == ("", []) and C.blocks_of("") == ("", [])


def test_packing():
    b = lambda text, path=("a",), kind="paragraph", **k: C.Block(kind, text, path, path[-1], **k)
    w = lambda n, x="w": " ".join([x] * n)
    assert [len(t.split()) for _, _, t in C.pack([b(w(200)), b(w(100)), b(w(100))], 350, 512, 40)] == [300, 100]
    assert [(p, len(t.split())) for p, _, t in C.pack([b(w(100)), b(w(10), ("b",)), b(w(10), ("c",))], 350, 512, 40)] == [(("a",), 120)]
    assert [(p, len(t.split())) for p, _, t in C.pack([b(w(10)), b(w(100), ("b",))], 350, 512, 40)] == [(("b",), 110)]
    long = C.pack([b("```py\n" + "\n".join([w(30)] * 30) + "\n```", kind="code")], 350, 512, 40)
    assert all(t.startswith("```py\n") and t.endswith("\n```") and len(t.split()) <= 512 for _, _, t in long) and len(long) > 1
    rows = tuple(f"| {w(50)} |" for _ in range(20))
    tables = C.pack([b("\n".join(("| h |", *rows)), kind="table", rows=rows, header="| h |")], 350, 512, 40)
    assert all(t.startswith("| h |") for _, _, t in tables) and len(tables) > 1
    assert all(len(t.split()) <= 512 for _, _, t in C.pack([b(w(2000))], 350, 512, 40))


def test_chunk_pages(spark):
    pages = spark.createDataFrame([("u", HTML), ("v", None), ("w", "")], "url string, html string")
    got = C.chunk_pages(pages, target=10, most=20, least=2).collect()
    assert {r["url"] for r in got} == {"u"} and [r["ordinal"] for r in got] == list(range(len(got))) and len({r["chunk_id"] for r in got}) == len(got)
    import hashlib

    r = got[0]
    assert r["chunk_id"] == hashlib.sha256(f"u\0{'/'.join(r['heading_path'])}\x000".encode()).hexdigest()[:16]
    assert C.page_blocks(pages).count() == 12


def test_size_stats(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (4,), (600,), (None,)], "n_tokens int")
    s = C.size_stats(df).first()
    assert (s["chunks"], s["tokens"], s["mean"], s["p50"], s["max"]) == (5, 610, 122.0, 3, 600)
    assert C.size_stats(df.limit(0)).first()["mean"] == 0.0
    h = {r["range"]: r["count"] for r in C.size_histogram(df).collect()}
    assert h["0-49"] == 4 and h["512+"] == 1 and h["50-99"] == 0 and len(h) == 11


def test_text_functions(spark):
    df = spark.createDataFrame([("  a b\tc  ", ["x", "y", "z"]), (None, None), ("w" * 300, [])], "t string, p array<string>")
    got = df.select(X.collapse_spaces("t").alias("c"), X.word_count("t").alias("n"), X.snippet("t").alias("s"), X.section_label("p").alias("l")).collect()
    assert (got[0]["c"], got[0]["n"], got[0]["s"], got[0]["l"]) == ("a b c", 3, "a b c", "y > z")
    assert got[1]["c"] is None and got[1]["l"] == "" and len(got[2]["s"]) == 223 and got[2]["s"].endswith("...")


def test_web(spark):
    maps = spark.createDataFrame([("<loc> https://h.example/stable/a.html </loc><loc>https://h.example/stable/notes/x.html</loc>",)], "xml string")
    assert col(web.url_list(web.sitemap_urls(maps), "stable", "2.1", "/notes/"), "url") == [("https://h.example/2.1/a.html",)]
    asked, tried = spark.createDataFrame([("ok",), ("bad",), ("busy",), ("had",), (None,)], "url string"), {}

    def get(url):
        tried[url] = tried.get(url, 0) + 1
        if url == "bad":
            return 404, "", None
        if url == "busy" and tried[url] < 3:
            return 503, "", 0.0
        return 200, f"<p>{url}", None

    known = spark.createDataFrame([("had", "<p>old")], "url string, html string")
    got = web.fetch(asked, get, known, pause=lambda s: None)
    assert col(got, "url", "status") == [("bad", "failed"), ("busy", "fetched"), ("had", "cached"), ("ok", "fetched")]
    m = web.manifest(got, "2.1", "now").first()
    assert (m["pages"], m["failed"]) == (4, 1)
    assert web.stable_version('<link rel="canonical" href="https://h.example/docs/2.1/x.html">', "https://h.example/docs") == "2.1" and web.stable_version("", "x") is None


def test_files(spark, tmp_path):
    d = str(tmp_path)
    (tmp_path / "site" / "a").mkdir(parents=True)
    (tmp_path / "site" / "a" / "index.html").write_bytes(b"<p>x\xff")
    (tmp_path / "site" / "b.html").write_text("<p>b")
    assert [u for u, _ in col(web.raw_pages(spark, f"{d}/site", "https://h.example"), "url", "html")] == ["https://h.example/a/", "https://h.example/b.html"]
    chunks = spark.createDataFrame([_chunk("c1", "u1", "one")], CH)
    files.write_jsonl(chunks, f"{d}/c")
    assert col(files.read_jsonl(spark, f"{d}/c"), "chunk_id", "text", "load_seq") == [("c1", "one", 0)]
    (tmp_path / "q.yaml").write_text("queries:\n- {id: q1, query: x, category: c, judgments: [{url: u, grade: 2, anchor: s}]}\n- {id: q2, query: y, category: c}\n")
    q, j = files.read_queries(spark, f"{d}/q.yaml")
    assert q.count() == 2 and col(j, "query_id", "unit", "grade") == [("q1", "u#s", 2)]
    pool = spark.createDataFrame([("q1", "x", "c", 0, "u", "T", "S", "sn<ip", "bm25@1", None)], files.POOL)
    assert files.write_pool(pool, f"{d}/p.yaml", ["bm25"], 10, "note") == 1
    assert col(files.read_pool(spark, f"{d}/p.yaml"), "url", "grade") == [("u", None)]
    assert files.write_grading_page(pool, f"{d}/p.html") == 1 and "q1-01" in (tmp_path / "p.html").read_text()
    (tmp_path / "g.txt").write_text("# x\nq1-01: 2\n\nq1-02: 9\n")
    assert col(files.read_grades(spark, f"{d}/g.txt"), "label", "grade") == [("q1-01", 2)]
    (tmp_path / "bad.json").write_text("{")
    assert files.read_cache(spark, f"{d}/bad.json").count() == 0 == files.read_cache(spark, f"{d}/none.json").count()


def test_stream(spark, tmp_path):
    d = str(tmp_path)
    files.write_jsonl(spark.createDataFrame([_chunk("c1", "u1", "one"), _chunk("c2", "u1", "two", ordinal=1)], CH), f"{d}/in")
    stream = lambda: upsert_stream(spark.readStream.schema(files.CHUNKS).json(f"{d}/in"), f"{d}/out", f"{d}/cp").awaitTermination()
    stream()
    assert col(read_corpus(spark, f"{d}/out")[1], "chunk_id", "text") == [("c1", "one"), ("c2", "two")]
    # a page is delivered again, a chunk moves to another page, others stay where they are
    spark.createDataFrame([_chunk("c2", "u9", "two"), _chunk("c3", "u1", "three")], CH).withColumn("load_seq", F.lit(None).cast("long")).write.mode("append").json(f"{d}/in")
    stream()
    pages, chunks = read_corpus(spark, f"{d}/out")
    assert col(chunks, "chunk_id", "url") == [("c2", "u9"), ("c3", "u1")] and col(pages, "url") == [("u1",), ("u9",)]
    seq = {r["chunk_id"]: r["load_seq"] for r in chunks.collect()}
    assert seq["c2"] < seq["c3"]
    assert col(read_corpus(spark, f"{d}/out", 0)[1], "chunk_id") == [("c1",), ("c2",)]


def test_stub_phrase_anywhere(spark):
    """A phrase at the end of a long text counts, whatever n_tokens says."""
    said = "word " * 600 + X.STUB_PHRASES[0]
    c = spark.createDataFrame([("a", "u", 0, said, None), ("b", "v", 0, "word " * 600, None)], "chunk_id string, url string, ordinal int, text string, n_tokens int")
    assert {r["url"]: r["status"] for r in quality.analyze(c).collect()} == {"u": "stub", "v": "ok"}


def test_hot_page_signature(spark):
    """A page of more chunks than are gathered at a time: order counts, the order of rows doesn't."""
    rows = [(f"c{i}", "u", i, f"text {i}", 1) for i in range(9000)]
    schema = "chunk_id string, url string, ordinal int, text string, n_tokens int"
    sign = lambda r: quality.page_texts(spark.createDataFrame(r, schema).repartition(5)).first()["signature"]
    assert sign(rows) == sign(rows[::-1]) != sign([(c, u, 8999 - o, t, n) for c, u, o, t, n in rows])
    assert quality.page_texts(spark.createDataFrame(rows, schema)).first()["n_chunks"] == 9000


def test_token_sizes():
    """Sizes by a public tokenizer's ranks; no chunk is above the limit."""
    count = C.TokenCount("/opt/tokenizers/byte_bpe_50k.tiktoken", r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    text = "Tensors are sharded over devices, and unshardable ones are replicated. " * 60
    got = C.pack([C.Block("paragraph", text, ("a",), "a"), C.Block("list", "- x", ("a",), "a")], 100, 120, 10, count)
    assert len(got) > 5 and all(count(t) <= 120 for _, _, t in got) and " ".join(" ".join(t for *_, t in got).split()) == " ".join((text + "- x").split())


def test_full_version(spark):
    page = spark.createDataFrame([('<a href="https://x.example/o/r/blob/v3.2.1/a.py">[source]</a>',), ("none",), (None,)], "html string")
    assert [r[0] for r in page.select(web.full_version("html", "x.example/o/r", "3.2")).collect()] == ["3.2.1", None, None]
