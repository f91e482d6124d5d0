import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import jsonx
from tessera.operators import agent, generation, metrics, pooling, reliability, report, resample


def col(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


RUN = "system string, query_id string, rank int, unit string"
QREL = "query_id string, unit string, grade int"


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("s", "q", 1, "b"), ("s", "q", 2, "x"), ("s", "q", 3, "a")], RUN)
    qrels = spark.createDataFrame([("q", "a", 2), ("q", "b", 1), ("q", "c", 0), ("r", "z", 1)], QREL)
    queries = spark.createDataFrame([("q", "k"), ("r", "k"), ("n", "k")], "query_id string, category string")
    got = {r["query_id"]: r for r in metrics.per_query(run, qrels, queries).collect()}
    assert set(got) == {"q", "r"} and got["q"]["recall_5"] == 1.0 and got["q"]["mrr"] == 1.0 and got["r"]["recall_10"] == 0.0
    want = (1 + 3 / math.log2(4)) / (3 + 1 / math.log2(3))
    assert abs(got["q"]["ndcg_10"] - want) < 1e-12 and abs(want - 0.68853) < 1e-5
    assert metrics.per_query(run, qrels, queries, include_unjudged=True).count() == 3
    s = {r["category"]: r for r in metrics.summarize(metrics.per_query(run, qrels, queries)).collect()}
    assert s["all"]["recall_5"] == 0.5 and s["k"]["n"] == 2
    assert len(metrics.text_table(metrics.summarize(metrics.per_query(run, qrels, queries)), ["mrr"])) == 4


def test_units(spark):
    """A judged section counts as itself, others as their page; repeats count at their first place."""
    run = spark.createDataFrame([("s", "q", 1, "c1"), ("s", "q", 2, "c2"), ("s", "q", 3, "c3"), ("s", "q", 4, "gone")], "system string, query_id string, rank int, chunk_id string")
    located = spark.createDataFrame([("c1", "p", "x"), ("c2", "p", "y"), ("c3", "p", None)], "chunk_id string, page string, anchor string")
    qrels = spark.createDataFrame([("q", "p#y", 2)], QREL)
    assert col(metrics.run_units(run, located, qrels), "rank", "unit") == [(1, "p"), (2, "p#y")]
    j = spark.createDataFrame([("q", "old#s", 1, 0), ("q", "new#s", 2, 1), ("q", "k", None, 2)], QREL + ", ord int")
    m = spark.createDataFrame([("old", "new")], "url string, page string")
    assert col(metrics.judged_units(j, m), "unit", "grade") == [("new#s", 2)]


def test_pool(spark):
    runs = spark.createDataFrame([("b", "q", 1, "c1"), ("a", "q", 1, "c2"), ("a", "q", 2, "c1"), ("a", "q", 11, "c3")], "system string, query_id string, rank int, chunk_id string")
    pages = spark.createDataFrame([("c1", "P"), ("c2", "P"), ("c3", "R")], "chunk_id string, page string")
    chunks = spark.createDataFrame([("c1", "one", "T1", ["h"]), ("c2", "two", None, None), ("c3", "x", "x", None)], "chunk_id string, text string, title string, heading_path array<string>")
    pool = pooling.build_pool(runs, pages, chunks, ["a", "b"])
    assert col(pool, "url", "title", "snippet", "found_by") == [("P", "", "two", "a@1, a@2, b@1")]
    queries = spark.createDataFrame([("q", "k"), ("r", "k")], "query_id string, category string")
    judged = spark.createDataFrame([("q", "P")], "query_id string, url string")
    assert col(pooling.delta_counts(pool, judged, queries), "query_id", "n_new", "n_already_judged") == [("q", 0, 1), ("r", 0, 0)]
    c = {r["category"]: r for r in pooling.coverage(pool, judged.limit(0), queries).collect()}
    assert c["all"]["unjudged"] == 1 and c["all"]["rate"] == 1.0 and c["all"]["fully_covered"] == 1
    old, new = spark.createDataFrame([("q", "u", 0)], QREL), spark.createDataFrame([("q", "u", 2), ("q", "v", 1), ("q", "v", 1)], QREL)
    added, conflicts = pooling.append_judgments(old, new)
    assert col(added, "unit", "grade") == [("u", 0), ("v", 1)] and col(conflicts, "unit") == [("u",)]
    assert pooling.merge_judgments(old, new).count() == 1 and pooling.merge_judgments(old, new, force=True).count() == 3


def test_agreement(spark):
    pairs = lambda p: spark.createDataFrame(p, "original int, regrade int")
    k = lambda p: reliability.kappa(pairs(p)).first()["kappa"]
    assert k([(0, 0), (1, 1)]) == 1.0 and k([(0, 1), (1, 0)]) == -1.0 and k([]) == 0.0 and k([(1, 1), (1, 1)]) == 0.0
    seen = [(0, 0)] * 18 + [(0, 1)] * 2 + [(1, 0)] * 8 + [(1, 1)] * 9 + [(1, 2)] * 3
    assert abs(k(seen) - 0.3953) < 5e-5
    assert col(reliability.confusion(pairs(seen)), "original", "g0", "g1", "g2") == [(0, 18, 2, 0), (1, 8, 9, 3), (2, 0, 0, 0)]
    t = spark.createDataFrame([(3, 1, 1, 3), (9, 11, 6, 14), (10, 0, 0, 10), (0, 0, 5, 5)], "a int, b int, c int, d int")
    p = {r["a"]: r["p_value"] for r in reliability.fisher_exact(t).collect()}
    assert abs(p[3] - 0.4857) < 5e-5 and abs(p[9] - 0.5145) < 5e-5 and p[10] < 1e-4 and p[0] == 1.0


def test_fisher_of_large_counts(spark):
    """A fold of factorials a table took time as the square of the counts; counts beyond 2^31 broke."""
    rows = [(50, 61, 70, 52), (70_000, 180_000, 293_000, 750_000), (1_000_000_000, 3_000_000_000, 1_000_000_000, 3_000_000_000), (30_000_000_000, 0, 0, 30_000_000_000), (None, 1, 1, 1)]
    got = {r["a"]: r["p_value"] for r in reliability.fisher_exact(spark.createDataFrame(rows, "a long, b long, c long, d long")).collect()}
    ways = {x: math.comb(111, x) * math.comb(122, 120 - x) for x in range(112)}
    assert abs(got[50] - sum(w for w in ways.values() if w <= ways[50]) / sum(ways.values())) < 1e-12
    z = (70_000 * 750_000 - 180_000 * 293_000) * math.sqrt(1_293_000 / (250_000 * 1_043_000 * 363_000 * 930_000))
    assert abs(got[70_000] / math.erfc(abs(z) / math.sqrt(2)) - 1) < 0.02
    assert got[1_000_000_000] == 1.0 and got[30_000_000_000] == 0.0 and got[None] is None
    assert reliability._two_sided(1000, 1030, 1030, 1000) == reliability._two_sided(1030, 1000, 1000, 1030)


def test_bootstrap(spark):
    rng = np.random.default_rng(0)
    qrels = [(f"q{i}", f"u{j}", int(rng.integers(0, 3))) for i in range(12) for j in range(8)]
    run = [(s, f"q{i}", r + 1, f"u{j}") for i in range(12) for s, o in (("a", range(8)), ("b", range(8)), ("c", range(7, -1, -1))) for r, j in enumerate(o)]
    q = spark.createDataFrame([(f"q{i}", "k" if i % 2 else "l") for i in range(12)], "query_id string, category string")
    t = spark.createDataFrame([(0, 1000, 0, 0), (1, 0, 1000, 0), (2, 0, 0, 1000)], "original int, g0 long, g1 long, g2 long")
    args = (spark.createDataFrame(run, RUN), spark.createDataFrame(qrels, QREL), q, t)
    draws = resample.paired_draws(*args, draws=60, seed=3).cache()
    same = resample.paired_intervals(draws, [("a", "b")])
    assert all(r["low"] == r["high"] == 0 and not r["decided"] for r in same.collect())
    again = resample.paired_draws(args[0].repartition(3), *args[1:], draws=60, seed=3)
    assert again.agg(F.round(F.sum("value"), 9)).first()[0] == draws.agg(F.round(F.sum("value"), 9)).first()[0]
    mid = {r["metric"]: r["mid"] for r in resample.intervals(draws.where("system = 'a' AND category = 'all'"), ["metric"]).collect()}
    m = metrics.summarize(metrics.per_query(args[0], args[1], q)).where("system = 'a' AND category = 'all'").first()
    assert abs(mid["ndcg_10"] - m["ndcg_10"]) < 0.08 and abs(mid["recall_5"] - m["recall_5"]) < 0.12
    blocks = resample.paired_draws(*args, draws=200, seed=3, block_judgments=20)  # five blocks of queries give what one gives
    assert blocks.count() == 200 * 3 * 3 * 6
    cut = {r["metric"]: r["mid"] for r in resample.intervals(blocks.where("system = 'a' AND category = 'all'"), ["metric"]).collect()}
    assert all(abs(cut[x] - mid[x]) < 0.05 for x in mid)
    assert all(r["low"] == r["high"] == 0 for r in resample.paired_intervals(blocks, [("a", "b")]).collect())
    assert resample.paired_draws(args[0], args[1].limit(0), *args[2:], draws=3).count() == 0
    ratios = spark.createDataFrame([("s", 2, 4)] * 30 + [("t", 1, 1)], "system string, supported int, total int")
    i = {r["system"]: r for r in resample.ratio_intervals(resample.ratio_draws(ratios, "system", draws=200), "system").collect()}
    assert i["s"]["low"] == i["s"]["high"] == 0.5 and i["t"]["low"] == 1.0


def test_routes_and_parts(spark):
    cases = [
        ('{"route": "decompose", "reason": " r "}', ("decompose", "r")), ('x ```json\n{"route": "Direct"}``` y', ("direct", "")), ('{"route": "other"}', None), ('{"route": 3}', None), ("nothing", None), (None, None), ("{bad", None),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").withColumn("p", jsonx.parse_route("t"))
    assert [None if r["p"] is None else tuple(r["p"]) for r in df.orderBy("i").collect()] == [w for _, w in cases]
    subs = [('{"sub_queries": ["a", " a ", 1, null, "", "b", "c", "d"]}', ["a", "b", "c"]), ('{"sub_queries": []}', None), ('{"sub_queries": "a"}', None), ("[1]", None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(subs)], "i int, t string").withColumn("p", jsonx.parse_sub_queries("t"))
    assert [r["p"] for r in df.orderBy("i").collect()] == [w for _, w in subs]


def test_answers(spark):
    raw = [
        ('{"answer": " x [C1] [C9] ", "refused": false}', (False, "x [C1] [C9]", [1], [9], True)), ('{"answer": "INSUFFICIENT_CONTEXT", "refused": true}', (True, "INSUFFICIENT_CONTEXT", [], [], True)),
        ('{"answer": "x", "refused": true}', (True, "x", [], [], False)), ('{"answer": 1, "refused": false}', (False, "", [], [], False)), ('{"answer": "x", "refused": "false"}', (False, "x", [], [], False)), ("[]", (False, "", [], [], False)), (None, (False, "", [], [], False)),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(raw)], "i int, t string").withColumn("a", jsonx.parse_answer("t", F.lit(3)))
    got = [(r["a"]["refused"], r["a"]["text"], r["a"]["cited"], r["a"]["dangling"], r["a"]["malformed"] == "") for r in df.orderBy("i").collect()]
    assert got == [w for _, w in raw]


def test_verdicts(spark):
    body = {"verdicts": [{"claim": 2, "supported": True, "passage": 9}, {"claim": "1", "supported": "false", "passage": 2}, {"claim": 2, "supported": False}, 5, {"claim": None}, {"claim": 8}]}
    df = spark.createDataFrame([(json.dumps(body),), ("no",)], "t string").withColumn("v", jsonx.parse_verdicts("t", F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(3)))
    one, two = [[tuple(x) for x in r["v"]] for r in df.collect()]
    assert one == [("a", True, 2, True), ("b", True, None, True), ("c", False, None, False)]
    assert two == [("a", False, None, False), ("b", False, None, False), ("c", False, None, False)]
    c = spark.createDataFrame([('{"claims": [" a ", 1, "", "b"]}',), ('{"claims": []}',), ("x",)], "t string").select(jsonx.parse_claims("t", 1).alias("c")).collect()
    assert [r["c"]["claims"] for r in c] == [["a"], [], []] and [r["c"]["error"] == "" for r in c] == [True, False, False]


def test_cache(spark):
    from tessera.functions.text import cache_key

    r = spark.createDataFrame([("m", "p1", "q1"), ("m", "p2", "q2")], "model string, prompt string, query string")
    hit = r.where("prompt = 'p1'").select(cache_key(F.col("model"), F.col("prompt"), F.col("query")).alias("key"), F.lit("t").alias("text"), F.lit(1).cast("long").alias("prompt_tokens"), F.lit(2).cast("long").alias("completion_tokens"), F.lit(0.5).alias("seconds"))
    assert col(agent.with_responses(r.where("prompt = 'p1'"), hit), "text", "cached") == [("t", True)]
    with pytest.raises(Exception, match="not in the cache"):
        agent.with_responses(r, hit).collect()
    import pandas as pd

    client = lambda p: pd.DataFrame({"text": "new " + p, "prompt_tokens": 1, "completion_tokens": 1, "seconds": 0.1})
    assert col(agent.with_responses(r, hit, client=client), "text", "cached") == [("new p2", False), ("t", True)]


def test_agent_and_probe(spark):
    subs = spark.createDataFrame([("q", 0, "x"), ("q", 1, "y")], "query_id string, sub_no int, sub_query string")
    found = {"x": ["a1", "a2", "c"], "y": ["c"]}

    def search(q, depth):
        rows = [(r["query_id"], i + 1, c) for r in q.collect() for i, c in enumerate(found[r["query"]])]
        return spark.createDataFrame(rows, "query_id string, rank int, chunk_id string")

    pages = spark.createDataFrame([("a1", "P"), ("a2", "P"), ("c", "C")], "chunk_id string, page string")
    got = col(agent.agent_search(subs, search, pages, 5), "rank", "page", "score")
    assert got == [(1, "C", round(1 / 62 + 1 / 61, 12)), (2, "P", round(1 / 61, 12))]
    q = spark.createDataFrame([(f"q{i}", i) for i in range(3)], "query_id string, ord long")
    pairs = generation.mismatch_pairs(q, 1)
    assert col(pairs, "query_id", "donor_id") == [("q0", "q1"), ("q1", "q2"), ("q2", "q0")]
    run = spark.createDataFrame([("q1", 1, "c")], "query_id string, rank int, chunk_id string")
    rel = spark.createDataFrame([("q0", "C")], "query_id string, page string")
    assert col(generation.probe_pairs(pairs, run, pages, rel), "query_id", "skipped") == [("q0", True), ("q1", False), ("q2", False)]


def test_latency(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 11)] + [("b", 5.0)] * 3 + [("b", None)], "k string, s double")
    got = {r["k"]: (r["n"], r["min_s"], r["p50"], r["p90"], r["max_s"], r["mean_s"]) for r in report.latency_table(df, "k", "s").collect()}
    assert got == {"a": (10, 1.0, 6.0, 10.0, 10.0, 5.5), "b": (3, 5.0, 5.0, 5.0, 5.0, 5.0)}


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_prompts(spark):
    """Slots are filled once and literally; refused, malformed and empty answers are not checked."""
    from tessera.operators import prompts

    df = spark.createDataFrame([("{query} {context}", "ctx {query}")], "q string, c string")
    got = df.select(prompts.filled("a {query} b {context} {other} {query}", query=F.col("q"), context=F.col("c")).alias("x")).first()[0]
    assert got == "a {query} {context} b ctx {query} {other} {query} {context}"
    asked = spark.createDataFrame([("q1", "what"), ("q2", None)], "query_id string, query string")
    assert [r["prompt"] for r in prompts.route_requests(asked, "m").orderBy("query_id").collect()] == [prompts.ROUTE.replace("{query}", x) for x in ("what", "")]
    answers = spark.createDataFrame([("s", "q1", "what", False, "", "yes [C1]"), ("s", "q2", "x", True, "", "no"), ("s", "q3", "x", False, "bad", "no"), ("s", "q4", "x", False, "", "")], "system string, query_id string, query string, refused boolean, malformed string, text string")
    claims = prompts.claim_requests(answers, "m").collect()
    assert [(r["query_id"], r["retriever"]) for r in claims] == [("q1", "s:claims")] and "yes [C1]" in claims[0]["prompt"] and "8" in claims[0]["prompt"]
    claimed = spark.createDataFrame([("s", "q1", "what", ["a", "b"])], "system string, query_id string, query string, claims array<string>")
    contexts = spark.createDataFrame([("s", "q1", "[C1] t")], "system string, query_id string, context string")
    assert "1. a\n2. b" in prompts.support_requests(claimed, contexts, "m").first()["prompt"]


def test_traces(spark):
    """A routed search leaves one row a query, which is what the summary reads."""
    from tessera.operators import agent

    routed = spark.createDataFrame([("q1", "a", "direct", "", False), ("q2", "b", "decompose", "", False), ("q3", "c", "direct", "", True)], "query_id string, query string, route string, reason string, route_fallback boolean")
    subs = spark.createDataFrame([("q1", False, 0, "a"), ("q2", False, 0, "x"), ("q2", False, 1, "y"), ("q3", False, 0, "c")], "query_id string, decompose_fallback boolean, sub_no int, sub_query string")
    calls = spark.createDataFrame([("q1", 5, 1, 1.0, True), ("q2", 5, 1, 1.0, False), ("q2", 7, 2, 2.0, True)], "query_id string, prompt_tokens long, completion_tokens long, seconds double, cached boolean")
    times = spark.createDataFrame([("q1", 0.5), ("q2", 1.5)], "query_id string, retrieval_seconds double")
    t = {r["query_id"]: r for r in agent.traces(routed, subs, calls, times).collect()}
    assert (t["q2"]["n_sub_queries"], t["q2"]["llm_calls"], t["q2"]["cache_hits"], t["q2"]["prompt_tokens"], t["q2"]["total_seconds"]) == (2, 2, 1, 12, 4.5)
    assert (t["q3"]["llm_calls"], t["q3"]["total_seconds"]) == (0, 0.0)
    lines = agent.trace_report(agent.summarize_traces(agent.traces(routed, subs, calls, times)))
    assert lines[0] == "queries 3: decomposed 1, direct 2" and "1 of 3 (33%)" in lines[1]


def test_equal_rows_resampled(spark):
    """Many equal rows cost what one does, and the interval of a mixture covers its share."""
    from tessera.operators import resample

    rows = spark.range(100_000).selectExpr("'g' AS system", "CAST(id % 4 = 0 AS INT) AS supported", "1 AS total")
    got = resample.ratio_intervals(resample.ratio_draws(rows, "system", draws=400), "system").first()
    assert 0.24 < got["low"] < 0.25 < got["high"] < 0.26


def test_cache_file(spark, tmp_path):
    from tessera.sources import files

    path = str(tmp_path / "c" / "cache.json")
    row = lambda k, t: (k, t, 1, 2, 0.5, "m", "q", None)
    assert files.write_cache(spark.createDataFrame([row("a", "x"), row("b", "y")], files.CACHE), path) == 2
    assert files.write_cache(spark.createDataFrame([row("b", "z")], files.CACHE), path) == 2
    assert sorted((r["key"], r["text"], r["completion_tokens"]) for r in files.read_cache(spark, path).collect()) == [("a", "x", 2), ("b", "z", 2)]
