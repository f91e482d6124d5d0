"""Routed search: a model's verdict routes each query, decomposed queries are searched in parts and fused.

The control flow is columns, not an interpreter: a route column, an exploded list of sub-queries, one
batch search over all of them, one fusion. Model answers come from a table of cached responses or an
injected client.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import MAX_SUB_QUERIES, parse_route, parse_sub_queries
from ..functions.text import cache_key
from . import fusion

#: Fixed value: results read of each sub-query.
SUB_DEPTH = 10


def with_responses(requests: DataFrame, cache: DataFrame, offline: bool = True, client: Callable[[pd.Series], pd.DataFrame] | None = None) -> DataFrame:
    """requests (with model, prompt, query and, if wanted, retriever) with text, prompt_tokens, completion_tokens, seconds, cached.

    Answers are looked up by key. A miss goes to ``client`` (prompts to a frame of text, prompt_tokens,
    completion_tokens, seconds) in Arrow batches; offline it is an error, raised when the row is read.
    A key that stands several times in the cache counts once.
    """
    parts = [F.col("model"), F.col("prompt"), F.col("query")]
    key = cache_key(*parts)
    if "retriever" in requests.columns:
        key = F.when(F.coalesce("retriever", F.lit("")) != "", cache_key(*parts, F.col("retriever"))).otherwise(key)
    known = cache.groupBy("key").agg(F.max(F.struct("text", "prompt_tokens", "completion_tokens", "seconds")).alias("_r"))
    rows = requests.withColumn("key", key).join(known, "key", "left").withColumn("cached", F.col("_r").isNotNull())
    if client is not None:

        @F.pandas_udf("text string, prompt_tokens long, completion_tokens long, seconds double")
        def ask(prompts: pd.Series) -> pd.DataFrame:
            return client(prompts)

        hit = rows.where("cached")
        miss = rows.where("NOT cached").withColumn("_r", ask("prompt"))
        rows = hit.unionByName(miss.select(*rows.columns))
    elif offline:
        rows = rows.withColumn("_r", F.when(F.col("cached"), F.col("_r")).otherwise(F.raise_error(F.concat(F.lit("not in the cache: "), F.col("key"))).cast(rows.schema["_r"].dataType)))
    return rows.select("*", "_r.*").drop("_r")


def route(queries: DataFrame, responses: DataFrame) -> DataFrame:
    """query_id, query, route, reason, route_fallback: an unreadable verdict goes the direct way. responses: query_id, text."""
    rows = queries.join(responses.select("query_id", F.col("text").alias("_t")), "query_id", "left").withColumn("_p", parse_route("_t"))
    return rows.select("query_id", "query", F.coalesce("_p.route", F.lit("direct")).alias("route"), F.coalesce("_p.reason", F.lit("")).alias("reason"), F.col("_p").isNull().alias("route_fallback"))


def sub_queries(routed: DataFrame, responses: DataFrame, most: int = MAX_SUB_QUERIES) -> DataFrame:
    """query_id, sub_no (from 0), sub_query, decompose_fallback: parts of decomposed queries; the query itself otherwise or if the parts are unreadable."""
    rows = routed.join(responses.select("query_id", F.col("text").alias("_t")), "query_id", "left")
    parts = F.when(F.col("route") == "decompose", parse_sub_queries("_t", most))
    rows = rows.withColumn("_parts", parts).withColumn("decompose_fallback", (F.col("route") == "decompose") & F.col("_parts").isNull())
    return rows.select("query_id", "decompose_fallback", F.posexplode(F.coalesce("_parts", F.array("query"))).alias("sub_no", "sub_query"))


def agent_search(subs: DataFrame, search: Callable[[DataFrame, int], DataFrame], pages: DataFrame, k: int, depth: int = SUB_DEPTH) -> DataFrame:
    """query_id, rank, chunk_id, page, score: all sub-queries searched in one batch and fused by page.

    search: (query_id, query) and depth to query_id, rank, chunk_id. Scores use the place among a list's
    pages, best_rank the place among its rows.
    """
    names = F.concat_ws("\0", F.col("query_id").cast("string"), F.col("sub_no").cast("string"))
    asked = subs.select(names.alias("_id"), "query_id", F.col("sub_no").cast("string").alias("system"), "sub_query")
    found = search(asked.select(F.col("_id").alias("query_id"), F.col("sub_query").alias("query")), depth)
    runs = found.withColumnRenamed("query_id", "_id").join(asked.select("_id", "query_id", "system"), "_id").select("system", "query_id", "rank", "chunk_id")
    return fusion.fuse(runs, pages, {str(i): i for i in range(MAX_SUB_QUERIES)}, k, depth=depth, compact=True)


def traces(routed: DataFrame, subs: DataFrame, responses: DataFrame, timings: DataFrame) -> DataFrame:
    """One row a query of a routed search, the columns that ``summarize_traces`` reads.

    routed and subs as of ``route`` and ``sub_queries``; responses: query_id, prompt_tokens, completion_tokens, seconds, cached, one row a
    model call; timings: query_id, retrieval_seconds. A query without calls or timing has zeros.
    """
    parts = subs.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_sub_queries"), F.max("decompose_fallback").alias("decompose_fallback"))
    calls = responses.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("llm_calls"), F.count_if("cached").alias("cache_hits"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("seconds").alias("llm_seconds")
    )
    spent = timings.groupBy("query_id").agg(F.sum("retrieval_seconds").alias("retrieval_seconds"))
    rows = routed.join(parts, "query_id", "left").join(calls, "query_id", "left").join(spent, "query_id", "left")
    rows = rows.na.fill(0, ["n_sub_queries", "llm_calls", "cache_hits", "prompt_tokens", "completion_tokens", "llm_seconds", "retrieval_seconds"]).na.fill(False, ["decompose_fallback"])
    return rows.withColumn("total_seconds", F.col("llm_seconds") + F.col("retrieval_seconds"))


def trace_report(summary: DataFrame) -> list[str]:
    """Lines of the one row that ``summarize_traces`` gives."""
    r = summary.first()
    share = lambda a, b: f"{a} of {b}" + (f" ({a / b:.0%})" if b else "")
    lines = [f"queries {r['n']}: decomposed {r['route_decompose']}, direct {r['route_direct']}", f"unreadable verdicts {share(r['route_fallbacks'], r['n'])}, unreadable parts {share(r['decompose_fallbacks'], r['route_decompose'])}"]
    lines.append(f"sub-queries {r['sub_queries_total']}, model calls {r['llm_calls']} ({r['cache_hits']} cached), tokens {r['prompt_tokens']} in and {r['completion_tokens']} out")
    for name in ("llm", "retrieval", "total"):
        lines.append(f"{name:<10}" + "".join(f"{s} {r[f'{name}_{s}_s'] or 0.0:>9.3f}  " for s in ("mean", "median", "max", "sum")).rstrip())
    return [*lines, f"the model's share of the time {r['model_share']:.1%}"]


def summarize_traces(traces: DataFrame) -> DataFrame:
    """One row over traces (route, route_fallback, decompose_fallback, n_sub_queries, llm_calls, cache_hits, tokens, llm_seconds, retrieval_seconds).

    The fallback rate of decomposition is over the queries that were decomposed; an empty table gives zeros.
    """
    z = lambda c: F.coalesce(c, F.lit(0))
    total = F.col("llm_seconds") + F.col("retrieval_seconds")
    attempts = F.count_if(F.col("route") == "decompose")
    stats = []
    for name, c in (("llm", F.col("llm_seconds")), ("retrieval", F.col("retrieval_seconds")), ("total", total)):
        stats += [F.avg(c).alias(f"{name}_mean_s"), F.percentile(c, F.lit(0.5)).alias(f"{name}_median_s"), F.max(c).alias(f"{name}_max_s"), F.sum(c).alias(f"{name}_sum_s")]
    return traces.agg(
        F.count(F.lit(1)).alias("n"), attempts.alias("route_decompose"), (F.count(F.lit(1)) - attempts).alias("route_direct"), F.count_if("route_fallback").alias("route_fallbacks"),
        F.count_if("decompose_fallback").alias("decompose_fallbacks"), z(F.count_if("decompose_fallback") / F.nullif(attempts, F.lit(0))).alias("decompose_fallback_rate"),
        z(F.sum("n_sub_queries")).alias("sub_queries_total"), F.avg("n_sub_queries").alias("sub_queries_mean"), z(F.sum("llm_calls")).alias("llm_calls"), z(F.sum("cache_hits")).alias("cache_hits"),
        z(F.sum("prompt_tokens")).alias("prompt_tokens"), z(F.sum("completion_tokens")).alias("completion_tokens"), *stats, z(F.sum("llm_seconds") / F.nullif(F.sum(total), F.lit(0.0))).alias("model_share"),
    )
