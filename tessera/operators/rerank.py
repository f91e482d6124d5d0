"""Second-stage ranking by an injected scorer, and the random baseline."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.analysis import plain_words
from ..plans.ranking import position_by_bucket, top_n
from ..plans.shared import materialize

#: Fixed value: how many of the base ranking are scored.
TOP_N = 100
#: Query texts and passages, to one score a row.
Scorer = Callable[[pd.Series, pd.Series], pd.Series]


def rerank(base: DataFrame, queries: DataFrame, passages: DataFrame, k: int, scorer: Scorer | None = None, top: int = TOP_N) -> DataFrame:
    """query_id, rank, chunk_id, score: the first max(top, k) of the base run by score; ties keep the base order.

    base: query_id, rank, chunk_id; queries: query_id, query; passages: chunk_id, text, one row a chunk. Chunks
    without a passage are left out. Without a scorer the share of the query's words in the passage is used.
    """
    texts = passages.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    rows = base.where(F.col("rank") <= max(top, k)).select("query_id", F.col("rank").alias("base_rank"), "chunk_id").join(texts, "chunk_id").join(queries.select("query_id", "query"), "query_id")
    if scorer is None:
        asked = F.array_distinct(plain_words("query"))
        score = F.coalesce(F.size(F.array_intersect(asked, plain_words("text"))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))
    else:

        @F.pandas_udf("double")
        def run(q: pd.Series, t: pd.Series) -> pd.Series:
            return scorer(q, t)

        score = run("query", "text")
    scored = rows.select("query_id", "base_rank", "chunk_id", F.round(score, 9).alias("score"))
    return top_n(scored, ["query_id"], [F.col("score").desc(), F.col("base_rank"), F.col("chunk_id")], max(0, k)).select("query_id", "rank", "chunk_id", "score")


def random_run(queries: DataFrame, items: DataFrame, k: int, seed: int = 0, item: str = "chunk_id") -> DataFrame:
    """query_id, rank, chunk_id: ``k`` items drawn without replacement for every query, a function of the seed.

    Items are numbered once in the order of a hash of the seed. A query draws numbers by a hash of (seed, query, draw), a
    number drawn before counts once; with few items it puts all numbers in the order of that hash. So no query meets all items
    of a large table, and only the number of items reaches the driver.
    """
    keyed = items.select(F.col(item).alias("chunk_id")).where("chunk_id IS NOT NULL").distinct().withColumn("_h", F.xxhash64(F.lit(seed), "chunk_id"))
    numbered = materialize(position_by_bucket(keyed, [], ["_h", "chunk_id"], "n").select("n", "chunk_id"), "items")
    total = numbered.count()
    want = min(k, total)
    if want < 1:
        return queries.select("query_id", F.lit(0).alias("rank"), F.lit("").alias("chunk_id")).limit(0)
    few = total <= 8 * want + 64
    draws = queries.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(total - 1 if few else 8 * want + 63))).alias("_i"))
    hashed = F.xxhash64(F.lit(seed + 1), "query_id", "_i")
    if few:
        drawn = draws.select("query_id", F.col("_i").cast("long").alias("n"), hashed.alias("_at"))
    else:
        drawn = draws.select("query_id", F.pmod(hashed, F.lit(total)).alias("n"), F.col("_i").cast("long").alias("_at")).groupBy("query_id", "n").agg(F.min("_at").alias("_at"))
    return top_n(drawn, ["query_id"], [F.col("_at"), F.col("n")], want).join(numbered, "n").select("query_id", "rank", "chunk_id")


def latency_stats(timings: DataFrame, by: list[str], seconds: str = "seconds", pairs: str | None = None) -> DataFrame:
    """Mean, median and maximum of a latency, and pairs scored a second."""
    out = [F.count(seconds).alias("n"), F.avg(seconds).alias("mean_s"), F.expr(f"percentile(`{seconds}`, 0.5)").alias("median_s"), F.max(seconds).alias("max_s")]
    if pairs:
        out.append((F.sum(pairs) / F.sum(seconds)).alias("pairs_per_s"))
    return timings.groupBy(*by).agg(*out)
