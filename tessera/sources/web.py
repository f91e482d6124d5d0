"""Pages from a sitemap or a mirror: URL lists, mirror paths, raw HTML, fetching with an injected client."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Answers that are worth another try, and the number of tries.
RETRIED, TRIES = (429, 500, 502, 503, 504), 4


def stable_version(html: str, base: str) -> str | None:
    """The version directory named by a page's canonical link under ``base``; None if there is none."""
    import re

    m = re.search(rf"""<link[^>]+rel=["']canonical["'][^>]+href=["']{re.escape(base.rstrip("/"))}/([^/"']+)/""", html)
    return m[1] if m else None


def full_version(html: str | Column, repository: str, version: str) -> Column:
    """The full release, such as 2.14.0, that a page's links to its source under ``repository`` name for a version; null if none does."""
    literal = lambda s: "".join("\\" + c if not c.isalnum() and c != "/" else c for c in s)
    return F.nullif(F.regexp_extract(html, rf"{literal(repository)}/blob/v({literal(version)}\.\d+)/", 1), F.lit(""))


def sitemap_urls(sitemaps: DataFrame, xml: str = "xml") -> DataFrame:
    """url of every location in sitemaps."""
    return sitemaps.select(F.explode(F.regexp_extract_all(xml, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url"))


def url_list(urls: DataFrame, stable: str, version: str, exclude: str | None = None) -> DataFrame:
    """Distinct URLs with ``/stable/`` rewritten to a version, without those that match ``exclude``, sorted."""
    rows = urls.where("url IS NOT NULL").select(F.replace("url", F.lit(f"/{stable}/"), F.lit(f"/{version}/")).alias("url"))
    if exclude:
        rows = rows.where(~F.col("url").rlike(exclude))
    return rows.distinct().orderBy("url")


def mirror_path(url: str | Column) -> Column:
    """The path of a URL in a mirror: its own path, ``index.html`` where it ends in a slash or is empty."""
    path = F.regexp_replace(F.coalesce(F.expr(f"try_parse_url({url if isinstance(url, str) else 'url'}, 'PATH')"), F.lit("")), "^/+", "")
    return F.when((path == "") | path.endswith("/"), F.concat(path, F.lit("index.html"))).otherwise(path)


def raw_pages(spark: SparkSession, folder: str, base: str) -> DataFrame:
    """url, html of every ``.html`` file below a folder; bytes that are not UTF-8 are replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.html").load(folder)
    root = folder.rstrip("/").removeprefix("file:")
    inside = F.regexp_replace(F.regexp_replace("path", "^file:(//)?", ""), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in root) + "/", "")
    return files.select(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(inside, "(^|/)index\\.html$", "$1")).alias("url"), F.make_valid_utf8(F.col("content").cast("string")).alias("html"))


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, str, float | None]], known: DataFrame | None = None, tries: int = TRIES, pause: Callable[[float], None] | None = None, partitions: int = 8) -> DataFrame:
    """url, status ('cached', 'fetched' or 'failed'), html, error.

    get: url to (HTTP status, body, seconds to wait or None). Answers in ``RETRIED`` and exceptions are tried again after
    the seconds asked for, or 1, 2, 4, ...; other answers from 400 on fail at once. Pages in ``known`` (url, html) are not asked for.
    """
    asked = urls.select("url").where("url IS NOT NULL").distinct()
    have = None
    if known is not None:
        have = asked.join(known.groupBy("url").agg(F.max("html").alias("html")), "url").select("url", F.lit("cached").alias("status"), "html", F.lit("").alias("error"))
        asked = asked.join(known.select("url").distinct(), "url", "left_anti")

    def one(url: str) -> tuple[str, str | None, str]:
        import time

        error = ""
        for n in range(tries):
            wait = float(2**n)
            try:
                code, body, after = get(url)
                if code < 400:
                    return "fetched", body, ""
                error = f"HTTP {code}"
                if code not in RETRIED:
                    break
                wait = after if after is not None else wait
            except Exception as e:  # noqa: BLE001 - any failure of the client is a failed page
                error = f"{type(e).__name__}: {e}"
            if n + 1 < tries:
                (pause or time.sleep)(wait)
        return "failed", None, error

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            got = [one(u) for u in names]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([g[i] for g in got], pa.string()) for i in range(3)]], names=["url", "status", "html", "error"])

    new = asked.repartition(partitions, "url").mapInArrow(run, "url string, status string, html string, error string")
    return new.unionByName(have) if have is not None else new


def manifest(fetched: DataFrame, version: str, fetched_at: str) -> DataFrame:
    """One row: version, fetched_at, counts by status, bytes, and the failures."""
    failed = F.col("status") == "failed"
    return fetched.agg(
        F.lit(version).alias("version"), F.lit(fetched_at).alias("fetched_at"), F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == "fetched").alias("fetched"), F.count_if(F.col("status") == "cached").alias("cached"), F.count_if(failed).alias("failed"),
        F.coalesce(F.sum(F.octet_length("html")), F.lit(0)).alias("bytes"),
    )


def host(url: str) -> str:
    return (urlsplit(url).hostname or "").lower()


def file_name(url: str) -> str:
    """The mirror file of one URL, for drivers that fetch outside Spark."""
    path = urlsplit(url).path.lstrip("/")
    return os.path.join(path, "index.html") if not path or path.endswith("/") else path
