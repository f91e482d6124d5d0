"""Stub filter, alias collapse, reciprocal rank fusion by page, and duplicate slots.

A run is (query_id, rank, chunk_id[, score]); a page map is (chunk_id, page[, status]).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ranking import top_n

#: The constant of rank fusion and the depth read of each system.
RRF_K, DEPTH = 60, 100


def page_map(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """chunk_id, url, page (canonical url, else the url), status of every chunk, one row a chunk_id.

    Pages that stand twice count once: an analysed row before one that isn't, then the smaller url. A
    chunk of an unknown page is its own url's, with status ok.
    """
    known = pages.where("url IS NOT NULL").groupBy("url").agg(F.max(F.when(F.col("canonical_url") != "", F.col("canonical_url"))).alias("canonical"), F.min(F.coalesce("status", F.lit("ok"))).alias("status"))
    ids = chunks.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.min("url").alias("url"))
    return ids.join(known, "url", "left").select("chunk_id", "url", F.coalesce("canonical", "url").alias("page"), F.coalesce("status", F.lit("ok")).alias("status"))


def collapse(run: DataFrame, pages: DataFrame, k: int, exclude_stubs: bool = True, collapse_aliases: bool = True) -> DataFrame:
    """The first ``k`` of each ranked list after dropping stubs and, then, later hits of a page already listed; ranks start at 1 again.

    The run's own pool cut comes first, so the order is pool, stubs, aliases, cut. Chunks that the map
    doesn't know share the page ''.
    """
    rows = run.join(pages.select("chunk_id", "page", "status"), "chunk_id", "left").withColumn("page", F.coalesce("page", F.lit("")))
    if exclude_stubs:
        rows = rows.where(F.coalesce("status", F.lit("ok")) == "ok")
    if collapse_aliases:
        rows = top_n(rows, ["query_id", "page"], [F.col("rank"), F.col("chunk_id")], 1, "_first").drop("_first")
    rows = rows.withColumnRenamed("rank", "_rank")
    return top_n(rows, ["query_id"], [F.col("_rank"), F.col("chunk_id")], max(0, k)).drop("_rank", "status")


def first_of_page(runs: DataFrame, pages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """system, query_id, page, rank, chunk_id: each page's first place in each list; ranks keep their gaps, unknown chunks go."""
    rows = runs.where(F.col("rank") <= depth).join(pages.select("chunk_id", "page"), "chunk_id")
    return top_n(rows, ["system", "query_id", "page"], [F.col("rank"), F.col("chunk_id")], 1, "_first").drop("_first").select("system", "query_id", "page", "rank", "chunk_id")


def fuse(runs: DataFrame, pages: DataFrame, order: Mapping[str, int], k: int, constant: int = RRF_K, depth: int = DEPTH, compact: bool = False) -> DataFrame:
    """query_id, rank, chunk_id, page, score, best_rank, ranks of pages fused over systems.

    The score sums 1 / (constant + rank). The page is shown by the chunk with the lowest rank, of equal
    ranks that of the system first in ``order``. ``compact`` scores by the place among pages, not rows.
    Order: score (12 decimals) descending, best rank, page.
    """
    firsts = first_of_page(runs, pages, depth)
    used = F.row_number().over(W.partitionBy("system", "query_id").orderBy("rank", "chunk_id")) if compact else F.col("rank")
    systems = F.create_map(*[F.lit(x) for s, i in order.items() for x in (s, i)])
    rows = firsts.withColumn("_used", used).withColumn("_at", F.struct("rank", F.coalesce(systems[F.col("system")], F.lit(len(order))).alias("o"), "system"))
    pages_ = rows.groupBy("query_id", "page").agg(
        F.round(F.sum(F.lit(1.0) / (F.lit(float(constant)) + F.col("_used"))), 12).alias("score"), F.min("rank").alias("best_rank"), F.min_by("chunk_id", "_at").alias("chunk_id"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("system", "rank")))).alias("ranks"),
    )
    return top_n(pages_, ["query_id"], [F.col("score").desc(), F.col("best_rank"), F.col("page")], max(0, k)).select("query_id", "rank", "chunk_id", "page", "score", "best_rank", "ranks")


def item_scores(runs: DataFrame, constant: int = RRF_K) -> DataFrame:
    """query_id, item, score: the plain sum of 1 / (constant + rank) over all rows."""
    return runs.groupBy("query_id", "item").agg(F.sum(F.lit(1.0) / (F.lit(float(constant)) + F.col("rank"))).alias("score"))


def duplicate_slots(run: DataFrame, pages: DataFrame) -> DataFrame:
    """system, query_id, n_slots, n_duplicates (page listed higher already), n_stubs."""
    rows = run.join(pages.select("chunk_id", "page", "status"), "chunk_id", "left").withColumn("page", F.coalesce("page", F.lit("")))
    seen = F.row_number().over(W.partitionBy("system", "query_id", "page").orderBy("rank", "chunk_id"))
    return rows.withColumn("_n", seen).groupBy("system", "query_id").agg(
        F.count(F.lit(1)).alias("n_slots"), F.count_if(F.col("_n") > 1).alias("n_duplicates"), F.count_if(F.coalesce("status", F.lit("ok")) != "ok").alias("n_stubs")
    )


def policies(run: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """The run under each of the four policies: with and without stubs, with and without alias collapse."""
    parts = [collapse(run, pages, k, s, c).withColumns({"exclude_stubs": F.lit(s), "collapse_aliases": F.lit(c)}) for s in (False, True) for c in (False, True)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def changed_lists(a: DataFrame, b: DataFrame) -> DataFrame:
    """query_id, changed: whether two runs list different chunks, or the same in another order."""
    listed = lambda r, n: r.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias(n))
    return listed(a, "_a").join(listed(b, "_b"), "query_id", "full_outer").select("query_id", (~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"))
