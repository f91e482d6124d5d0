import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera.functions import analysis
from tessera.functions import text as X
from tessera.operators import bm25, dense, fusion, rerank
from tessera.plans import queries


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


DOCS = [
    ("c1", "Cross entropy", ["loss", "Cross entropy"], "loom.nn.cross_entropy computes the loss of naïve classes. Losses add."),
    ("c2", "Top k", ["ops"], "loom.topk returns the largest; topk alone, loom alone, running runners ran"),
    ("c3", "Adam", ["optim"], "An optimizer with running averages of the gradient and generalizations"),
    ("c4", "Empty", None, None),
    ("c5", "Loss of Adam", ["loss", "Adam"], "naive losses and the loom.topk of losses"),
]
QUERIES = [("q1", "naïve losses of loom.topk"), ("q2", "running Adam"), ("q3", "the of"), ("q4", None), ("q5", "zzz 42"), ("q6", "loss losses")]


def test_bm25_equals_sqlite(spark):
    """Scores with stems, folding, phrases and field weights are SQLite's."""
    docs = spark.createDataFrame(DOCS, "chunk_id string, title string, heading_path array<string>, text string")
    queries = spark.createDataFrame(QUERIES, "query_id string, query string")
    got = {(r["query_id"], r["doc"]): r["score"] for r in bm25.search(bm25.build_index(docs), queries, 10).collect()}
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table f using fts5(title, heading_path, text, tokenize=\"porter unicode61 tokenchars '_'\")")
    for i, (_, t, h, x) in enumerate(DOCS):
        c.execute("insert into f(rowid, title, heading_path, text) values (?, ?, ?, ?)", (i + 1, t, " > ".join(h or []), x or ""))
    match = {r["query_id"]: r["m"] for r in queries.select("query_id", X.match_expression("query").alias("m")).collect()}
    want = {}
    for q, m in match.items():
        if m:
            for rowid, s in c.execute("select rowid, bm25(f, 3.0, 2.0, 1.0) from f where f match ?", (m,)):
                want[(q, DOCS[rowid - 1][0])] = round(-s, 9)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_bm25_empty_and_repeats(spark):
    docs = spark.createDataFrame(DOCS + DOCS, "chunk_id string, title string, heading_path array<string>, text string")
    once = spark.createDataFrame(DOCS, docs.schema)
    q = spark.createDataFrame(QUERIES, "query_id string, query string")
    a = sorted(rows(bm25.search(bm25.build_index(docs, stem=False), q, 3, stem=False), "query_id", "rank", "doc", "score"))
    assert a == sorted(rows(bm25.search(bm25.build_index(once, stem=False), q, 3, stem=False), "query_id", "rank", "doc", "score"))
    assert bm25.search(bm25.build_index(once.limit(0), stem=False), q, 3, stem=False).count() == 0
    assert bm25.search(bm25.build_index(once, stem=False), q, 0, stem=False).count() == 0


def test_porter():
    cases = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "relational": "relat", "generalizations": "gener", "cross_entropy": "cross_entropi", "sky": "sky", "be": "be"}
    assert {w: analysis.porter(w) for w in cases} == cases
    assert analysis.terms_of("Naïve CAFÉ x_1") == ["naiv", "cafe", "x_1"] and analysis.terms_of(None) == []


def test_match_terms(spark):
    q = spark.createDataFrame([("How do I use loom.nn.Linear with 3 layers?",), ("",), ("the a of",)], "q string")
    got = [r["m"] for r in q.select(X.match_expression("q").alias("m")).collect()]
    assert got == ['"loom.nn.linear" OR "loom" OR "nn" OR "linear" OR "3" OR "layers"', "", ""]


def test_dense_search(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [2.0, 0.0]), ("c", [0.0, 1.0]), ("d", [0.0, 0.0]), ("e", None), ("f", [1.0]), ("a", [1.0, 0.0])], "chunk_id string, vec array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.1]), ("z", [0.0, 0.0])], "query_id string, vec array<float>")
    assert rows(dense.search(q, v, 2, 2).orderBy("rank"), "query_id", "rank", "item") == [("q", 1, "a"), ("q", 2, "b")]
    assert dense.search(q, v.limit(0), 2, 2).count() == 0
    e = dense.encode(spark.createDataFrame([("x", "T", ["h"], None), ("y", None, None, "T h")], "chunk_id string, title string, heading_path array<string>, text string"))
    vecs = {r["chunk_id"]: r["vec"] for r in e.collect()}
    assert vecs["x"] == vecs["y"] and abs(sum(x * x for x in vecs["x"]) - 1) < 1e-6


def test_dense_search_hot_items(spark):
    """Items with more equal or more different vectors than a block gives leave the places of other items."""
    hot = [("a", [1.0, 0.0])] * 30 + [("b", [1.0, 0.001 * i]) for i in range(30)]
    v = spark.createDataFrame(hot + [("c", [1.0, 0.5]), ("d", [1.0, 1.0]), ("e", [0.0, 1.0])], "chunk_id string, vec array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, vec array<float>")
    want = [(1, "a", 1.0), (2, "b", 1.0), (3, "c", 0.894427191), (4, "d", 0.707106781)]
    assert rows(dense.search(q, v, 4, 2).orderBy("rank"), "rank", "item", "score") == want


def test_fingerprint(spark):
    a = spark.createDataFrame([("a", "1"), ("b", None)], "chunk_id string, content_hash string")
    b = spark.createDataFrame([("b", None), ("a", "1")], a.schema)
    c = spark.createDataFrame([("a", "2"), ("b", None)], a.schema)
    f = [dense.fingerprint(x).first()[0] for x in (a, b, c)]
    assert f[0] == f[1] != f[2]
    assert dense.is_stale(c, dense.fingerprint(a)).first()["stale"] and not dense.is_stale(b, dense.fingerprint(a)).first()["stale"]


def _pages(spark):
    return spark.createDataFrame([("a1", "u1", "P", "ok"), ("a2", "u2", "P", "ok"), ("b", "u3", "u3", "stub"), ("c", "u4", "u4", "ok")], "chunk_id string, url string, page string, status string")


def test_collapse_order(spark):
    """A stub goes before pages collapse, ranks start again, unknown chunks share a page."""
    run = spark.createDataFrame([("q", 1, "b"), ("q", 2, "a2"), ("q", 3, "a1"), ("q", 4, "x"), ("q", 5, "y"), ("q", 6, "c")], "query_id string, rank int, chunk_id string")
    assert rows(fusion.collapse(run, _pages(spark), 10).orderBy("rank"), "rank", "chunk_id") == [(1, "a2"), (2, "x"), (3, "c")]
    assert fusion.policies(run, _pages(spark), 10).count() == 6 + 5 + 4 + 3


def test_fuse(spark):
    """A page listed twice pays once, agreement wins, ties fall to the better rank and then the page."""
    run = spark.createDataFrame(
        [("s", "q", 1, "a1"), ("s", "q", 2, "a2"), ("s", "q", 3, "c"), ("t", "q", 1, "c"), ("t", "q", 2, "b"), ("t", "q", 3, "nope")], "system string, query_id string, rank int, chunk_id string"
    )
    got = rows(fusion.fuse(run, _pages(spark), {"s": 0, "t": 1}, 10).orderBy("rank"), "page", "chunk_id", "score", "best_rank", "ranks")
    assert got == [("u4", "c", round(1 / 63 + 1 / 61, 12), 1, {"s": 3, "t": 1}), ("P", "a1", round(1 / 61, 12), 1, {"s": 1}), ("u3", "b", round(1 / 62, 12), 2, {"t": 2})]
    compact = {r["page"]: r["score"] for r in fusion.fuse(run, _pages(spark), {"s": 0, "t": 1}, 10, compact=True).collect()}
    assert compact["u4"] == round(1 / 62 + 1 / 61, 12)
    d = fusion.duplicate_slots(run, _pages(spark)).where("system = 's'").first()
    assert (d["n_slots"], d["n_duplicates"], d["n_stubs"]) == (3, 1, 0)


def test_rerank(spark):
    """Ties keep the base order, chunks without a passage go, an injected scorer is used."""
    base = spark.createDataFrame([("q", 1, "c"), ("q", 2, "a"), ("q", 3, "gone"), ("q", 4, "b")], "query_id string, rank int, chunk_id string")
    q = spark.createDataFrame([("q", "x y")], "query_id string, query string")
    t = spark.createDataFrame([("a", "x"), ("b", "x y"), ("c", "y"), ("c", "y")], "chunk_id string, text string")
    assert [r[0] for r in rows(rerank.rerank(base, q, t, 3).orderBy("rank"), "chunk_id")] == ["b", "c", "a"]
    assert [r[0] for r in rows(rerank.rerank(base, q, t, 1, scorer=lambda q, t: (t == "x") * 1.0), "chunk_id")] == ["a"]


def test_rerank_overlap_scores_every_chunk(spark, tmp_path):
    """The best chunk of a long title has the largest chunk_id, behind more than rerank.TOP_N others."""
    c = [(f"c{i:03d}", "u", i, "Change log", "change" if i < 140 else "change log") for i in range(150)]
    spark.createDataFrame(c, "chunk_id string, url string, ordinal int, title string, text string").write.parquet(f"{tmp_path}/chunks.parquet")
    got = rows(queries.queries()["rerank_overlap"](spark, str(tmp_path)).orderBy("rank"), "rank", "chunk_id", "score")
    assert got == [(i + 1, f"c{140 + i}", 1.0) for i in range(10)]


def test_random_run(spark):
    q = spark.createDataFrame([("q1",), ("q2",)], "query_id string")
    items = spark.createDataFrame([(f"c{i}",) for i in range(30)] + [(None,)], "chunk_id string")
    a = sorted(rows(rerank.random_run(q, items, 10, 1), "query_id", "rank", "chunk_id"))
    assert a == sorted(rows(rerank.random_run(q, items, 10, 1), "query_id", "rank", "chunk_id"))
    assert all(len({c for x, _, c in a if x == n}) == 10 for n in ("q1", "q2"))
    assert rerank.random_run(q, items.limit(0), 10, 1).count() == 0 and rerank.random_run(q, items, 99, 1).count() == 60


def test_dense_ways_agree(spark):
    """Queries sent to the vectors and block against block give the same lists; an item that stands often takes one place."""
    import numpy as np

    r = np.random.default_rng(3)
    rows = [(f"v{i:03d}", r.normal(size=8).tolist()) for i in range(300)] + [("v007", r.normal(size=8).tolist()) for _ in range(40)] + [("v008", [1.0] * 8)] * 50 + [("n", None), ("z", [0.0] * 8), ("short", [1.0]), (None, [1.0] * 8)]
    index = spark.createDataFrame(rows, "chunk_id string, vec array<float>").repartition(7)
    asked = spark.createDataFrame([("a", [1.0] * 8), ("b", rows[7][1]), ("c", None)], "query_id string, vec array<float>")
    ways = [[tuple(x) for x in dense.search(asked, index, 5, 8, sent_bytes=n).orderBy("query_id", "rank").collect()] for n in (2**20, 0)]
    assert ways[0] == ways[1] and len(ways[0]) == 10
    assert ways[0][0][2] == "v008" and len({x[2] for x in ways[0][:5]}) == 5
    assert dense.search(asked, index.limit(0), 5, 8).count() == 0 and dense.search(asked.limit(0), index, 5, 8).count() == 0


def test_switches():
    from tessera.operators import retrievers

    assert retrievers.switches(["bm25", "dense"], keep_aliases=True) == {"collapse_aliases": False}
    assert retrievers.switches(["hybrid"]) == {}
    with pytest.raises(ValueError, match="hybrid"):
        retrievers.switches(["bm25", "hybrid"], keep_stubs=True)


def test_searches_by_name(spark):
    """All searches of a small corpus answer; what the agent reads decides whether a query is split; scores come from one written run."""
    from tessera.operators import retrievers

    texts = ["the tensor of a layer", "a queue of a worker", "tensor and queue", "the stub was moved"]
    chunks = spark.createDataFrame([(f"c{i}", f"u{i}", "t", ["h"], 0, t) for i, t in enumerate(texts)], "chunk_id string, url string, title string, heading_path array<string>, ordinal int, text string")
    pages = spark.createDataFrame([(f"u{i}", "", "stub" if i == 3 else "ok") for i in range(4)], "url string, canonical_url string, status string")
    vectors = dense.encode(chunks).select("chunk_id", "vec")
    corpus = retrievers.Corpus(chunks, fusion.page_map(chunks, pages), bm25.build_index(chunks), vectors)
    asked = spark.createDataFrame([("q1", "tensor"), ("q2", "queue and worker"), ("q3", "moved")], "query_id string, query string")
    verdicts = spark.createDataFrame([("q1", '{"route": "direct"}'), ("q2", '{"route": "decompose"}'), ("q3", "?")], "query_id string, text string")
    parts = spark.createDataFrame([("q2", '{"sub_queries": ["queue", "worker"]}')], "query_id string, text string")
    searches = retrievers.registry(corpus, verdicts=verdicts, parts=parts)
    assert sorted(searches) == ["agent", "bm25", "dense", "hybrid", "rerank(bm25)", "rerank(hybrid)"]
    runs = retrievers.run_all(searches, asked, 3)
    assert {r["system"] for r in runs.collect()} == set(searches) and runs.where("chunk_id = 'c3'").count() == 0
    qrels = spark.createDataFrame([("q1", "u0", 2), ("q2", "u1", 2)], "query_id string, unit string, grade int")
    scores = retrievers.evaluate(searches, asked.withColumn("category", F.lit("x")), qrels, corpus.pages.withColumn("anchor", F.lit("")), 3)
    assert scores.count() == 12 and scores.where("system = 'bm25' AND recall_10 = 1").count() == 2
    assert retrievers.registry(retrievers.Corpus(chunks, corpus.pages, corpus.index), keep_stubs=True)["bm25"](asked, 3).where("chunk_id = 'c3'").count() == 1


def test_random_draws(spark):
    """Distinct items for every query, different ones for different queries, the same again for the same seed."""
    from tessera.operators import rerank

    asked = spark.createDataFrame([(f"q{i}",) for i in range(20)], "query_id string")
    for n, k in ((5000, 10), (30, 10), (5, 10)):
        items = spark.range(n).selectExpr("'c' || id AS chunk_id")
        got = [tuple(r) for r in rerank.random_run(asked, items, k, 1).orderBy("query_id", "rank").collect()]
        lists = [tuple(c for q, _, c in got if q == f"q{i}") for i in range(20)]
        assert all(len(set(x)) == min(k, n) for x in lists) and (n < 30 or len(set(lists)) == 20)
        assert got == [tuple(r) for r in rerank.random_run(asked, items, k, 1).orderBy("query_id", "rank").collect()]


def _common_and_rare(spark):
    docs = spark.createDataFrame([(f"d{i:03}", "alpha" if i % 3 else "beta", "alpha beta gamma"[: 5 + i % 12] + f" w{i // 3} v{i % 7}") for i in range(90)], "chunk_id string, title string, text string")
    queries = spark.createDataFrame([(f"q{i}", f"alpha w{i} beta.gamma" if i % 2 else f"alpha w{i}") for i in range(20)] + [("none", "zz"), ("common", "alpha")], "query_id string, query string")
    return bm25.build_index(docs, fields=["title", "text"], stem=False), queries


def test_common_phrases_are_ranked_once(spark, monkeypatch):
    """20 queries that share common phrases score those phrases' documents once for all, with the results of full scoring."""
    index, queries = _common_and_rare(spark)
    monkeypatch.setattr(bm25, "FEW", 10**6)
    whole = sorted(map(tuple, bm25.search(index, queries, 7, stem=False).collect()))
    monkeypatch.setattr(bm25, "FEW", 4)
    assert sorted(map(tuple, bm25.search(index, queries, 7, stem=False).collect())) == whole and len(whole) == 21 * 7
    lists = bm25._Lists(index, bm25.query_phrases(queries, stem=False), 7, bm25.WEIGHTS)
    assert lists.tail.count() == 2 * 7 and lists.rare.count() == 20 * 3


def test_pages_of_a_search_without_its_pool(spark, monkeypatch):
    """The best pages of each query equal those of the whole pool, also where stubs fill the pool."""
    index, queries = _common_and_rare(spark)
    pages = spark.createDataFrame([(f"d{i:03}", f"p{i // 2}", "stub" if i % 5 < 2 else "ok") for i in range(80)], "chunk_id string, page string, status string")
    monkeypatch.setattr(bm25, "FEW", 4)
    for k, pool in ((3, 60), (4, 9)):
        whole = fusion.collapse(bm25.search(index, queries, pool, stem=False).withColumnRenamed("doc", "chunk_id"), pages, k)
        got = bm25.search_pages(index, queries, pages, k, pool, stem=False)
        assert got.columns == whole.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, whole.collect()))
