"""Graded relevance metrics of runs over a table of queries.

run: system, query_id, rank, unit; qrels: query_id, unit, grade[, ord]; queries: query_id, category.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ranking import top_n

#: Cut-offs of recall and nDCG, and the tolerance of a tie.
RECALL_KS, NDCG_K, TIE = (5, 10), 10, 1e-12


def judged_units(qrels: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One grade a query and unit; with a url map (url, page) units are rewritten to their canonical page, keeping ``#anchor``.

    Of several judgments of a unit the last by ``ord`` counts, then the greater grade.
    """
    rows = qrels.withColumn("ord", F.col("ord") if "ord" in qrels.columns else F.lit(0))
    if pages is not None:
        url, anchor = F.split_part(F.col("unit"), F.lit("#"), F.lit(1)), F.regexp_extract("unit", "(#.*)$", 1)
        known = pages.select(F.col("url").alias("_url"), F.col("page").alias("_page")).distinct()
        rows = rows.withColumn("_url", url).withColumn("_anchor", anchor).join(known, "_url", "left")
        rows = rows.withColumn("unit", F.concat(F.coalesce("_page", "_url"), "_anchor"))
    return rows.where("unit IS NOT NULL AND grade IS NOT NULL").groupBy("query_id", "unit").agg(F.max_by("grade", F.struct("ord", "grade")).alias("grade"))


def run_units(run: DataFrame, located: DataFrame, qrels: DataFrame) -> DataFrame:
    """system, query_id, rank, unit: chunks become judged units, each once, at its first place; ranks are made dense.

    located: chunk_id, page, anchor. A chunk is its page with the anchor if that unit is judged for the
    query, else its page. Chunks without a place are left out.
    """
    rows = run.join(located.select("chunk_id", "page", "anchor"), "chunk_id")
    section = F.when(F.coalesce("anchor", F.lit("")) != "", F.concat("page", F.lit("#"), "anchor"))
    judged = qrels.select("query_id", F.col("unit").alias("_section")).distinct().withColumn("_judged", F.lit(True))
    rows = rows.withColumn("_section", section).join(judged, ["query_id", "_section"], "left")
    rows = rows.withColumn("unit", F.when(F.col("_judged"), F.col("_section")).otherwise(F.col("page")))
    first = rows.groupBy("system", "query_id", "unit").agg(F.min("rank").alias("_rank"))
    return first.select("system", "query_id", F.row_number().over(W.partitionBy("system", "query_id").orderBy("_rank", "unit")).alias("rank"), "unit")


def per_query(run: DataFrame, qrels: DataFrame, queries: DataFrame, include_unjudged: bool = False, systems: list[str] | None = None) -> DataFrame:
    """system, query_id, category, judged, n_relevant, recall_5, recall_10, mrr, ndcg_10, ceiling_5, ceiling_10.

    Every query meets every system, so a query without results scores 0; queries without judgments are
    left out unless asked for. Ceilings are null where nothing is relevant. Units repeated in a run count once.
    """
    if systems is not None:
        names = run.sparkSession.createDataFrame([(systems,)], "_systems array<string>")
    else:
        names = run.agg(F.array_sort(F.collect_set("system")).alias("_systems"))  # one row, of a handful of names
    judged = qrels.groupBy("query_id").agg(F.count(F.lit(1)).alias("judged"), F.count_if(F.col("grade") > 0).alias("n_relevant"))
    asked = queries.select("query_id", "category").join(judged, "query_id", "left" if include_unjudged else "inner").na.fill(0, ["judged", "n_relevant"])
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    ideal = top_n(qrels.where("grade > 0"), ["query_id"], [F.col("grade").desc(), F.col("unit")], NDCG_K, "_r").groupBy("query_id").agg(F.sum(gain(F.col("grade"), F.col("_r"))).alias("_ideal"))
    hits = run.join(qrels.where("grade > 0").select("query_id", "unit", "grade"), ["query_id", "unit"])
    found = hits.groupBy("system", "query_id").agg(
        *[F.count_if(F.col("rank") <= k).alias(f"_hits_{k}") for k in RECALL_KS], F.min("rank").alias("_first"), F.sum(F.when(F.col("rank") <= NDCG_K, gain(F.col("grade"), F.col("rank")))).alias("_dcg")
    )
    every = asked.crossJoin(F.broadcast(names)).withColumn("system", F.explode("_systems")).drop("_systems")
    rows = every.join(found, ["system", "query_id"], "left").join(ideal, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    relevant = F.nullif(F.col("n_relevant").cast("double"), F.lit(0.0))
    return rows.select(
        "system", "query_id", "category", "judged", "n_relevant", *[zero(F.col(f"_hits_{k}") / relevant).alias(f"recall_{k}") for k in RECALL_KS],
        zero(1.0 / F.col("_first")).alias("mrr"), zero(F.col("_dcg") / F.col("_ideal")).alias("ndcg_10"), *[(F.least(F.lit(float(k)), relevant) / relevant).alias(f"ceiling_{k}") for k in RECALL_KS],
    )


def summarize(scores: DataFrame, by: str = "system") -> DataFrame:
    """Means of the metrics overall ('all') and for each category, with the share of the ceiling in both readings."""
    metrics = ["recall_5", "recall_10", "mrr", "ndcg_10"]
    share = [(F.avg(F.col(f"recall_{k}") / F.col(f"ceiling_{k}"))).alias(f"mean_share_{k}") for k in RECALL_KS]
    ratio = [(F.avg(f"recall_{k}") / F.avg(f"ceiling_{k}")).alias(f"share_of_means_{k}") for k in RECALL_KS]
    out = scores.rollup(by, "category").agg(F.grouping("category").alias("_all"), F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics], *[F.avg(f"ceiling_{k}").alias(f"ceiling_{k}") for k in RECALL_KS], *share, *ratio)
    return out.where(F.col(by).isNotNull()).withColumn("category", F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("category"))).drop("_all")


def ceiling(qrels: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """category ('all' too), n, ceiling: the mean of min(k, R) / R over queries with R relevant units."""
    r = qrels.where("grade > 0").groupBy("query_id").agg(F.count(F.lit(1)).cast("double").alias("r"))
    rows = queries.select("query_id", "category").join(r, "query_id")
    out = rows.rollup("category").agg(F.grouping("category").alias("_all"), F.count(F.lit(1)).alias("n"), F.avg(F.least(F.lit(float(k)), F.col("r")) / F.col("r")).alias("ceiling"))
    return out.withColumn("category", F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("category"))).drop("_all")


def win_loss_tie(scores: DataFrame, a: str, b: str, metric: str = "recall_5") -> DataFrame:
    """wins, losses, ties, n of system ``a`` against ``b`` over the queries that both have."""
    side = lambda s, n: scores.where(F.col("system") == s).select("query_id", F.col(metric).alias(n))
    d: Column = F.col("_a") - F.col("_b")
    return side(a, "_a").join(side(b, "_b"), "query_id").agg(
        F.count_if(d > TIE).alias("wins"), F.count_if(d < -TIE).alias("losses"), F.count_if(F.abs(d) <= TIE).alias("ties"), F.count(F.lit(1)).alias("n")
    )


def text_table(summary: DataFrame, columns: list[str]) -> list[str]:
    """Lines of a small summary (a row a system and category) for printing."""
    rows = summary.select("system", "category", *columns).orderBy("system", F.col("category") != "all", "category").collect()
    head = f"{'system':<16}{'category':<14}" + "".join(f"{c:>12}" for c in columns)
    return [head, "-" * len(head), *[f"{r['system']:<16}{r['category'] or '':<14}" + "".join(f"{r[c]:>12.3f}" if r[c] is not None else f"{'-':>12}" for c in columns) for r in rows]]
