"""One ranking from the scores of several systems, by reciprocal rank fusion.

Scores are only used to order the chunks of one list (a system's answer to a query), so no scale can
dominate. A chunk's fused score is the sum over the query's lists of 1 / (constant + place). A chunk
that a list lacks has the place after its last. With the usual constant, 60, high places count more;
as the constant grows the order becomes that of the mean place. ``mean_place_constant`` is large
enough for that in exact numbers: for places up to L in S lists the second-order term of the sum stays
below half of the effect of one place if the constant is at least 2 S (L + 1)^2. A double tells such scores apart
only for short lists, so ``lowest_mean_place`` orders all chunks by the sum of their places, a whole number, and by
the fused score only where these are equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import place_by_key, top_n

RRF_CONSTANT = 60


def counted_lists(rankings: DataFrame, chunks: DataFrame, systems: DataFrame) -> DataFrame:
    """query_id, system, chunk_id, key: the best score of each chunk in each list, turned so that smaller is better.

    Left out are rows with a null (or NaN) score, a null query, system or chunk, a chunk_id that is
    not in ``chunks`` and a system that is not in ``systems``. ``rank`` and ``run_at`` are not used, so
    late and repeated rows count like others. A null ``higher_is_better`` counts as true.
    """
    side = systems.groupBy("system").agg(F.coalesce(F.max("higher_is_better"), F.lit(True)).alias("_up"))
    rows = rankings.select("system", "query_id", "chunk_id", "score").where("score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL")
    known = chunks.select("chunk_id").where("chunk_id IS NOT NULL").distinct()
    best = rows.groupBy("query_id", "system", "chunk_id").agg(F.max("score").alias("_max"), F.min("score").alias("_min"))
    return best.join(known, "chunk_id", "left_semi").join(side, "system").select("query_id", "system", "chunk_id", F.when(F.col("_up"), -F.col("_max")).otherwise(F.col("_min")).alias("key"))


def fuse(lists: DataFrame, constant: float | Column | None = RRF_CONSTANT) -> DataFrame:
    """query_id, chunk_id, score, mean_place, n_lists, ranks (system to place), of lists from ``counted_lists``.

    Equal keys share the better place. ``constant`` None takes the query's ``mean_place_constant``.
    A list of any size is placed by many tasks; a missing chunk costs no row: the sum starts from
    what a chunk missing everywhere would have and adds the differences.
    """
    placed = place_by_key(lists, ["query_id", "system"], "key")
    sizes = lists.groupBy("query_id", "system").agg(F.count(F.lit(1)).alias("list_size"))
    per_query = sizes.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_lists"), F.max("list_size").alias("_longest"), F.sum(F.col("list_size") + 1).alias("_all_missing"), F.collect_list("list_size").alias("_sizes"))
    k = mean_place_constant() if constant is None else (constant if isinstance(constant, Column) else F.lit(float(constant)))
    per_query = per_query.withColumn("_k", k).withColumn("_base", F.aggregate("_sizes", F.lit(0.0), lambda a, n: a + 1.0 / (F.col("_k") + n + 1))).drop("_sizes", "_longest")
    rows = placed.join(per_query, "query_id")
    gain = 1.0 / (F.col("_k") + F.col("place")) - 1.0 / (F.col("_k") + F.col("list_size") + 1)
    return (
        rows.groupBy("query_id", "chunk_id")
        .agg(
            F.first("n_lists").alias("n_lists"), F.first("_base").alias("_base"), F.first("_all_missing").alias("_missing"), F.sum(gain).alias("_gain"),
            F.sum(F.col("place") - F.col("list_size") - 1).alias("_better"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("system", F.col("place").cast("int"))))).alias("ranks"),
        )
        .select("query_id", "chunk_id", (F.col("_base") + F.col("_gain")).alias("score"), ((F.col("_missing") + F.col("_better")) / F.col("n_lists")).alias("mean_place"), "n_lists", "ranks")
    )


def mean_place_constant() -> Column:
    return (2 * F.col("n_lists") * (F.col("_longest") + 2) * (F.col("_longest") + 2)).cast("double")


def fused_ranking(fused: DataFrame, depth: int) -> DataFrame:
    """The first ``depth`` chunks of each query by fused score; equal scores by smaller chunk_id."""
    return top_n(fused, ["query_id"], [F.round("score", 15).desc(), F.col("chunk_id")], depth)


def lowest_mean_place(lists: DataFrame, n: int = 3) -> DataFrame:
    """The ``n`` chunks of each query with the lowest mean place; equal ones by fused score at the query's mean-place constant, then chunk_id.

    All chunks of all lists are ordered; nothing is cut before by an approximate score.
    """
    return top_n(fuse(lists, None), ["query_id"], [F.col("mean_place"), F.col("score").desc(), F.col("chunk_id")], n)
