"""Grounded answers over retrieved passages: contexts, parsed answers, claim checks, the refusal probe.

answers: system, query_id, category, chunk_ids, refused, text, cited, dangling, malformed, verdicts, model_seconds,
retrieval_seconds, prompt_tokens, completion_tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx, text

#: Passages of a context, and the rotation of the probe.
K, MISMATCH_OFFSET = 10, 20


def contexts(run: DataFrame, chunks: DataFrame, k: int = K) -> DataFrame:
    """query_id, chunk_ids, context: the first ``k`` passages of each query, numbered; unknown chunks are left out.

    A list is at most ``k`` long, so gathering it is bounded.
    """
    details = chunks.where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("text"), "title", F.coalesce("heading_path", F.array().cast("array<string>")).alias("heading_path"))).alias("d"))
    rows = run.where(F.col("rank") <= k).join(details, "chunk_id")
    lists = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "d.title", "d.heading_path", "d.text"))).alias("_p"))
    return lists.select("query_id", F.transform("_p", lambda p: p["chunk_id"]).alias("chunk_ids"), text.context_block("_p").alias("context"))


def answers(responses: DataFrame) -> DataFrame:
    """responses (query_id, chunk_ids, raw, ...) with refused, text, cited, dangling, malformed, cited_chunk_ids, n_words."""
    rows = responses.withColumn("_a", jsonx.parse_answer("raw", F.size("chunk_ids"))).select("*", "_a.*").drop("_a")
    return rows.withColumn("cited_chunk_ids", jsonx.cited_chunks("cited", "chunk_ids")).withColumn("n_words", text.word_count("text"))


def summarize_answers(answers_: DataFrame, by: str = "system") -> DataFrame:
    return answers_.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("refused").alias("refused"), F.count_if(F.col("malformed") != "").alias("malformed"), F.count_if(F.size("dangling") > 0).alias("with_dangling"), F.avg("model_seconds").alias("mean_model_s")
    )


def checked(answers_: DataFrame, claims: DataFrame, support: DataFrame) -> DataFrame:
    """answers with claims and verdicts: refused, malformed and empty answers have none.

    claims, support: system, query_id, raw, the two model answers of each check.
    """
    key = ["system", "query_id"]
    rows = answers_.join(claims.select(*key, F.col("raw").alias("_c")), key, "left").join(support.select(*key, F.col("raw").alias("_s")), key, "left")
    scored = ~F.col("refused") & (F.col("malformed") == "") & (F.col("text") != "")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("_p", F.when(scored, jsonx.parse_claims("_c"))).withColumn("claims", F.coalesce("_p.claims", none))
    return rows.withColumn("verdicts", jsonx.parse_verdicts("_s", "claims", F.size("chunk_ids"))).drop("_c", "_s", "_p")


def relevant_pages(judgments: DataFrame, canonical: DataFrame) -> DataFrame:
    """query_id, page: canonical pages judged 1 or better."""
    known = canonical.select(F.col("url").alias("_u"), F.col("page").alias("_p")).distinct()
    url = F.split_part(F.col("unit"), F.lit("#"), F.lit(1))
    return judgments.where("grade >= 1").select("query_id", url.alias("_u")).join(known, "_u", "left").select("query_id", F.coalesce("_p", "_u").alias("page")).distinct()


def mismatch_pairs(queries: DataFrame, offset: int = MISMATCH_OFFSET) -> DataFrame:
    """query_id, donor_id: each query with the one ``offset`` places on, in turn. queries: query_id, ord (0, 1, ...)."""
    n = queries.agg((F.max("ord") + 1).alias("_n"))  # one row
    asked = queries.select("query_id", "ord").crossJoin(F.broadcast(n)).withColumn("_d", F.pmod(F.col("ord") + offset, F.col("_n")))
    return asked.join(queries.select(F.col("query_id").alias("donor_id"), F.col("ord").alias("_d")), "_d").select("query_id", "donor_id")


def probe_pairs(pairs: DataFrame, run: DataFrame, pages: DataFrame, relevant: DataFrame, k: int = K) -> DataFrame:
    """query_id, donor_id, skipped: a pair is skipped if a page of the donor's context is relevant to the query."""
    donor = run.where(F.col("rank") <= k).join(pages.select("chunk_id", "page"), "chunk_id").select(F.col("query_id").alias("donor_id"), "page").distinct()
    hit = pairs.join(donor, "donor_id").join(relevant, ["query_id", "page"], "left_semi").select("query_id", "donor_id").distinct().withColumn("_h", F.lit(True))
    return pairs.join(hit, ["query_id", "donor_id"], "left").select("query_id", "donor_id", F.col("_h").isNotNull().alias("skipped"))


def summarize_checks(checked_: DataFrame, probe: DataFrame | None = None, by: str = "system") -> DataFrame:
    """Counts of answers, claims and support, medians of latency, and the probe's refusals (probe: system, skipped, refused)."""
    answered = ~F.col("refused") & (F.col("malformed") == "")
    n, ok = F.when(answered, F.size("verdicts")).otherwise(0), F.when(answered, F.size(F.filter("verdicts", lambda v: v["supported"]))).otherwise(0)
    rows = checked_.withColumn("_n", n).withColumn("_ok", ok)
    z = lambda c: F.coalesce(c, F.lit(0.0))
    out = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("queries"), F.count_if("refused").alias("refused"), F.count_if(F.col("malformed") != "").alias("malformed"), F.sum(F.size("dangling")).alias("dangling_citations"), F.count_if(answered).alias("answers_scored"),
        F.sum("_n").alias("claims"), F.sum("_ok").alias("supported"), z(F.bround(F.sum("_n") / F.nullif(F.count_if(answered), F.lit(0)), 2)).alias("claims_per_answer"),
        z(F.bround(F.sum("_ok") / F.nullif(F.sum("_n"), F.lit(0)), 3)).alias("support_rate"), F.count_if((F.col("_n") > 0) & (F.col("_n") == F.col("_ok"))).alias("answers_fully_supported"),
        F.percentile("model_seconds", F.lit(0.5)).alias("median_model_s"), F.percentile("retrieval_seconds", F.lit(0.5)).alias("median_retrieval_s"), F.avg("prompt_tokens").alias("mean_prompt_tokens"), F.avg("completion_tokens").alias("mean_completion_tokens"),
    )
    if probe is None:
        return out
    scored = F.count_if(~F.col("skipped"))
    refused = F.count_if(~F.col("skipped") & F.col("refused"))
    p = probe.groupBy(by).agg(F.count(F.lit(1)).alias("probe_pairs"), scored.alias("probe_scored"), F.count_if("skipped").alias("probe_skipped"), refused.alias("probe_refused"), z(F.bround(refused / F.nullif(scored, F.lit(0)), 3)).alias("refusal_rate"))
    return out.join(p, by, "left")
