"""Judgment pools: union of the systems' best pages, what is new in it, appending judgments, coverage.

runs: system, query_id, rank, chunk_id; pages: chunk_id, page (see fusion.page_map); judgments: query_id, unit, grade.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import section_label, snippet


def _order(systems: Sequence[str]) -> Column:
    at = F.create_map(*[F.lit(x) for i, s in enumerate(systems) for x in (s, i)])
    return F.coalesce(at[F.col("system")], F.lit(len(systems)))


def build_pool(runs: DataFrame, pages: DataFrame, chunks: DataFrame, systems: Sequence[str], k: int = 10) -> DataFrame:
    """query_id, url, title, section, snippet, found_by of every page in a system's first ``k``.

    Title, section and snippet are of the chunk that the first system (in the order given) found best;
    found_by lists ``name@rank`` in that order, a page found twice by one system twice.
    """
    details = chunks.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "title", "heading_path")).alias("d"))
    rows = runs.where(F.col("rank") <= k).join(pages.select("chunk_id", "page"), "chunk_id").withColumn("_o", _order(systems))
    first = rows.groupBy("query_id", "page").agg(
        F.min_by("chunk_id", F.struct("_o", "rank", "system")).alias("chunk_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_o", "rank", "system"))), lambda s: F.concat(s["system"], F.lit("@"), s["rank"].cast("string"))), ", ").alias("found_by")
    )
    return first.join(details, "chunk_id").select("query_id", F.col("page").alias("url"), F.coalesce("d.title", F.lit("")).alias("title"), section_label("d.heading_path").alias("section"), snippet("d.text").alias("snippet"), "found_by")


def judged_pages(judgments: DataFrame, canonical: DataFrame) -> DataFrame:
    """query_id, url: canonical pages judged at any grade."""
    url = F.split_part(F.col("unit"), F.lit("#"), F.lit(1))
    known = canonical.select(F.col("url").alias("_u"), F.col("page").alias("_p")).distinct()
    return judgments.where("grade IS NOT NULL").select("query_id", url.alias("_u")).join(known, "_u", "left").select("query_id", F.coalesce("_p", "_u").alias("url")).distinct()


def delta_pool(pool: DataFrame, judged: DataFrame) -> DataFrame:
    """The pool's candidates that no judgment covers."""
    return pool.join(judged, ["query_id", "url"], "left_anti")


def delta_counts(pool: DataFrame, judged: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, category, n_new, n_already_judged; queries without candidates count 0."""
    marked = pool.select("query_id", "url").join(judged.withColumn("_j", F.lit(True)), ["query_id", "url"], "left")
    n = marked.groupBy("query_id").agg(F.count_if(F.col("_j").isNull()).alias("n_new"), F.count_if(F.col("_j").isNotNull()).alias("n_already_judged"))
    return queries.select("query_id", "category").join(n, "query_id", "left").na.fill(0, ["n_new", "n_already_judged"])


def delta_totals(counts: DataFrame) -> DataFrame:
    """query_id (null for all), category, n_new, n_already_judged, pooled, n_queries, n_empty (queries with nothing new), from ``delta_counts``."""
    out = counts.groupingSets([["query_id", "category"], []], "query_id", "category").agg(
        F.sum("n_new").alias("n_new"), F.sum("n_already_judged").alias("n_already_judged"), F.sum(F.col("n_new") + F.col("n_already_judged")).alias("pooled"), F.count(F.lit(1)).alias("n_queries"), F.count_if(F.col("n_new") == 0).alias("n_empty")
    )
    return out


def coverage(pool: DataFrame, judged: DataFrame, queries: DataFrame) -> DataFrame:
    """category ('all' too), n_queries, retrieved, unjudged, rate, distinct_new_pages, fully_covered."""
    per = delta_counts(pool, judged, queries)
    new = delta_pool(pool, judged).select("query_id", "url").join(queries.select("query_id", "category"), "query_id")
    overall = lambda df: df.withColumn("category", F.explode(F.array(F.lit("all"), F.coalesce("category", F.lit("?")))))
    n = overall(per).groupBy("category").agg(F.count(F.lit(1)).alias("n_queries"), F.sum(F.col("n_new") + F.col("n_already_judged")).alias("retrieved"), F.sum("n_new").alias("unjudged"), F.count_if(F.col("n_new") == 0).alias("fully_covered"))
    pages = overall(new).groupBy("category").agg(F.count_distinct("url").alias("distinct_new_pages"))
    rate = F.coalesce(F.col("unjudged") / F.nullif(F.col("retrieved"), F.lit(0)), F.lit(0.0))
    return n.join(pages, "category", "left").select("category", "n_queries", "retrieved", "unjudged", rate.alias("rate"), F.coalesce("distinct_new_pages", F.lit(0)).alias("distinct_new_pages"), "fully_covered")


def system_coverage(runs: DataFrame, pages: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """system ('union' too), pooled, unjudged, rate over distinct (query, page)."""
    rows = runs.where(F.col("rank") <= k).join(pages.select("chunk_id", F.col("page").alias("url")), "chunk_id").select("system", "query_id", "url")
    rows = rows.withColumn("system", F.explode(F.array(F.lit("union"), F.col("system")))).distinct().join(judged.withColumn("_j", F.lit(True)), ["query_id", "url"], "left")
    out = rows.groupBy("system").agg(F.count(F.lit(1)).alias("pooled"), F.count_if(F.col("_j").isNull()).alias("unjudged"))
    return out.withColumn("rate", F.col("unjudged") / F.col("pooled"))


def graded(pool: DataFrame) -> DataFrame:
    """query_id, unit, grade of the candidates that were graded."""
    return pool.where("grade IS NOT NULL").select("query_id", F.col("url").alias("unit"), "grade")


def merge_judgments(old: DataFrame, new: DataFrame, force: bool = False) -> DataFrame:
    """old with the blocks of the queries in ``new`` put in place; queries judged before are skipped unless forced."""
    judged, given = old.select("query_id").distinct(), new.select("query_id").distinct()
    if force:
        return old.join(given, "query_id", "left_anti").unionByName(new.select(*old.columns))
    return old.unionByName(new.join(judged, "query_id", "left_anti").select(*old.columns))


def append_judgments(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(old plus the judgments of units not judged before, conflicts): a judged unit is never overwritten. Repeats in ``new`` count once, at the greatest grade."""
    new = new.groupBy("query_id", "unit").agg(F.max("grade").alias("grade"))
    known = old.select("query_id", "unit").distinct()
    added = new.join(known, ["query_id", "unit"], "left_anti")
    return old.select("query_id", "unit", "grade").unionByName(added), new.join(known, ["query_id", "unit"], "left_semi")
