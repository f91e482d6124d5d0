"""Alias pages, placeholder pages and the quality report of a corpus."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


#: Chunks of a page whose hashes are gathered at a time.
RANGE = 4096


def page_texts(chunks: DataFrame) -> DataFrame:
    """url, n_chunks, n_tokens, signature, says_stub (of the first chunk's whole text) of every page that has chunks.

    The signature covers the texts in order of ordinal, identifiers cut to their last segment. Exact
    repeats of a chunk count once. Hashes are gathered by ranges of ``RANGE`` ordinals and hashed again, then the
    ranges' digests, so the chunks of a page of any size are never in one task. Null texts are empty.
    """
    rows = chunks.where("url IS NOT NULL").select("url", "chunk_id", "ordinal", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))
    hashed = rows.select("url", "chunk_id", "ordinal", "n_tokens", F.sha2(T.short_identifiers("text"), 256).alias("_h"), T.says_stub(F.col("text")).alias("_stub"))
    once = hashed.groupBy("url", "chunk_id", "ordinal").agg(F.min(F.struct("n_tokens", "_h", "_stub")).alias("_v")).select("url", "chunk_id", "ordinal", "_v.*")
    first = F.min(F.struct("ordinal", "chunk_id", "_stub"))
    gather = lambda order, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("v")))), lambda p: p["v"]), "\n"), 256)
    ranges = once.groupBy("url", F.floor(F.col("ordinal") / RANGE).alias("_range")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t"), gather(("ordinal", "chunk_id"), "_h").alias("_digest"), first.alias("_first"))
    pages = ranges.groupBy("url").agg(F.sum("n").alias("n_chunks"), F.sum("t").alias("n_tokens"), gather(("_range",), "_digest").alias("signature"), F.min("_first").alias("_first"))
    return pages.select("url", "n_chunks", "n_tokens", "signature", F.col("_first._stub").alias("says_stub"))


def first_fit(urls: list[str]) -> list[list[str]]:
    """Clusters of urls in sorted order: each joins the first cluster all of whose members it is compatible with."""
    import re

    def parts(url: str) -> tuple[list[str], frozenset[str]]:
        base = url.rstrip("/").split("/")[-1].removesuffix(".html").removesuffix("_class")
        return (base.split(".") if base else []), frozenset(re.findall(T.DEVICES, base))

    def within(a: list[str], b: list[str]) -> bool:
        at = 0
        for x in a:
            while at < len(b) and b[at] != x:
                at += 1
            if at == len(b):
                return False
            at += 1
        return True

    known = {u: parts(u) for u in urls}
    clusters: list[list[str]] = []
    for u in sorted(urls):
        segments, devices = known[u]
        for c in clusters:
            if all(known[o][1] == devices and (within(segments, known[o][0]) or within(known[o][0], segments)) for o in c):
                c.append(u)
                break
        else:
            clusters.append([u])
    return clusters


def alias_clusters(pages: DataFrame) -> DataFrame:
    """signature, url, canonical_url, cluster_size for pages whose signature stands on several urls.

    Clusters are first-fit in url order within (signature, devices): pages of different devices never
    meet, so they need not be in one task. Order matters, so a cluster step can't be a join; only
    signatures on several urls reach it.
    """
    shared = pages.groupBy("signature").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("signature")
    rows = pages.join(shared, "signature").select("signature", "url", F.array_join(T.device_set(T.path_segments("url")), ",").alias("devices"))

    def run(table: pa.Table) -> pa.Table:
        out: list[tuple[str, str, int]] = []
        for c in first_fit(table.column("url").to_pylist()):
            canonical = min(c, key=lambda u: (len(u), u))
            out += [(u, canonical, len(c)) for u in c]
        n = len(out)
        return pa.table({"signature": table.column("signature")[:1].take(pa.array([0] * n)), "url": [o[0] for o in out], "canonical_url": [o[1] for o in out], "cluster_size": pa.array([o[2] for o in out], pa.int32())})

    return rows.groupBy("signature", "devices").applyInArrow(run, "signature string, url string, canonical_url string, cluster_size int")


def alias_groups(clusters: DataFrame) -> DataFrame:
    """canonical_url, urls (sorted) of every group of at least two pages."""
    return clusters.where("cluster_size > 1").groupBy("signature", "canonical_url").agg(F.array_sort(F.collect_list("url")).alias("urls")).select("canonical_url", "urls")


def text_only_collisions(clusters: DataFrame) -> DataFrame:
    """One row: how many signatures split into several clusters, groups that equal text alone would have merged."""
    per = clusters.groupBy("signature").agg(F.count_distinct("canonical_url").alias("n"))
    return per.agg(F.count_if(F.col("n") > 1).alias("collisions"))


def analyze(chunks: DataFrame) -> DataFrame:
    """url, canonical_url (itself where it has no alias), status ('ok' or 'stub') of every page with chunks."""
    pages = page_texts(chunks)
    groups = alias_clusters(pages).where("cluster_size > 1").select("url", "canonical_url")
    return pages.join(groups, "url", "left").select("url", F.coalesce("canonical_url", "url").alias("canonical_url"), F.when(T.is_stub(F.col("n_chunks"), F.col("n_tokens"), F.col("says_stub")), F.lit("stub")).otherwise(F.lit("ok")).alias("status"))


def report(analysis: DataFrame) -> DataFrame:
    """One row: n_alias_pages (pages in groups), n_groups, n_redundant (pages that are not canonical), n_stubs."""
    groups = analysis.groupBy("canonical_url").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "stub").alias("s"))
    return groups.agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_alias_pages"), F.count_if(F.col("n") > 1).alias("n_groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_redundant"), F.coalesce(F.sum("s"), F.lit(0)).alias("n_stubs"))


def apply_quality(pages: DataFrame, analysis: DataFrame) -> DataFrame:
    """pages with canonical_url and status from the analysis; a page without chunks is its own and ok. Applying it again changes nothing."""
    found = analysis.select("url", F.col("canonical_url").alias("_c"), F.col("status").alias("_s"))
    return pages.join(found, "url", "left").withColumn("canonical_url", F.coalesce("_c", "url")).withColumn("status", F.coalesce("_s", F.lit("ok"))).drop("_c", "_s").select(*pages.columns)


def canonical_map(pages: DataFrame) -> DataFrame:
    """url, canonical_url of the pages that are another's alias."""
    return pages.where("canonical_url <> '' AND canonical_url <> url").select("url", "canonical_url").distinct()


def stub_urls(pages: DataFrame) -> DataFrame:
    return pages.where("status <> 'ok'").select("url").distinct()


def quality_counts(pages: DataFrame) -> DataFrame:
    """One row: stubs, redundant and unanalyzed pages."""
    c = F.coalesce("canonical_url", F.lit(""))
    return pages.agg(F.count_if(F.col("status") != "ok").alias("stubs"), F.count_if((c != "") & (c != F.col("url"))).alias("redundant"), F.count_if(c == "").alias("unanalyzed"))
