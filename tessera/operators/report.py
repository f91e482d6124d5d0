"""Report tables over checked answers: support, categories, citations, latency, refusals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scored(checked: DataFrame) -> DataFrame:
    """Answers that were not refused or malformed and have verdicts."""
    return checked.where(~F.col("refused") & (F.col("malformed") == "") & (F.size("verdicts") > 0))


def support_pairs(checked: DataFrame, judged_only: bool) -> DataFrame:
    """system, query_id, category, supported, total of each scored answer with claims in this reading."""
    kept = F.filter("verdicts", lambda v: v["judged"]) if judged_only else F.col("verdicts")
    rows = scored(checked).withColumn("_v", kept).where(F.size("_v") > 0)
    return rows.select("system", "query_id", "category", F.size(F.filter("_v", lambda v: v["supported"])).alias("supported"), F.size("_v").alias("total"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def support_table(checked: DataFrame) -> DataFrame:
    """system, category ('all' for both), claims, judged, rate_all (unjudged counts as unsupported), rate_judged; from one cube."""
    v = scored(checked).select("system", F.coalesce("category", F.lit("?")).alias("category"), F.explode("verdicts").alias("v"))
    out = v.cube("system", "category").agg(F.count(F.lit(1)).alias("claims"), F.count_if("v.judged").alias("judged"), F.count_if("v.supported").alias("_s"), F.count_if(F.col("v.supported") & F.col("v.judged")).alias("_j"))
    return out.select(F.coalesce("system", F.lit("all")).alias("system"), F.coalesce("category", F.lit("all")).alias("category"), "claims", "judged", _ratio(F.col("_s"), F.col("claims")).alias("rate_all"), _ratio(F.col("_j"), F.col("judged")).alias("rate_judged"))


def citation_table(checked: DataFrame) -> DataFrame:
    """system ('all' too), scored_answers, citations, dangling, dangling_rate, uncited."""
    rows = checked.where(~F.col("refused") & (F.col("malformed") == ""))
    out = rows.rollup("system").agg(F.count(F.lit(1)).alias("scored_answers"), F.sum(F.size("cited")).alias("citations"), F.sum(F.size("dangling")).alias("dangling"), F.count_if(F.size("cited") == 0).alias("uncited"))
    return out.select(F.coalesce("system", F.lit("all")).alias("system"), "scored_answers", "citations", "dangling", _ratio(F.col("dangling"), F.col("citations") + F.col("dangling")).alias("dangling_rate"), "uncited")


def latency_table(timings: DataFrame, by: str, seconds: str, partitions: int | None = None) -> DataFrame:
    """by, n, min_s, p50, p90, max_s, mean_s, with percentiles by index and no interpolation.

    Groups of any size: values are placed by many tasks and the two places are picked by their number.
    """
    from ..plans.ranking import place_by_key

    rows = timings.where(F.col(seconds).isNotNull()).select(by, F.col(seconds).cast("double").alias("_v"))
    counted = rows.groupBy(by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = place_by_key(rows, [by], "_v", "_first", "_size", partitions).select(by, "_v", "_first", "_size").distinct().join(counted, [by, "_v"])
    at = lambda q: F.min(F.when(F.least(F.floor(F.lit(q) * F.col("_size")), F.col("_size") - 1) + 1 < F.col("_first") + F.col("_c"), F.col("_v")))
    return placed.groupBy(by).agg(F.max("_size").alias("n"), F.min("_v").alias("min_s"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("_v").alias("max_s"), (F.sum(F.col("_v") * F.col("_c")) / F.sum("_c")).alias("mean_s"))


def refusal_table(checked: DataFrame, probe: DataFrame) -> DataFrame:
    """system, refusals, answers, probe_pairs, dropped, probe_refused, correct_refusal."""
    a = checked.groupBy("system").agg(F.count_if("refused").alias("refusals"), F.count(F.lit(1)).alias("answers"))
    p = probe.groupBy("system").agg(F.count_if(~F.col("skipped")).alias("probe_pairs"), F.count_if("skipped").alias("dropped"), F.count_if(~F.col("skipped") & F.col("refused")).alias("probe_refused"))
    return a.join(p, "system", "left").withColumn("correct_refusal", _ratio(F.col("probe_refused"), F.col("probe_pairs")))
