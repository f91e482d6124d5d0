"""Loading batches of chunks into a corpus: idempotent upsert, lookups and counts.

The corpus is two tables, pages and chunks, rewritten as new DataFrames: a batch replaces the chunks of
the pages it holds, keeps all others, and what quality analysis wrote on a page survives.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import source_of_url
from ..plans.shared import materialize
from ..sources.schemas import CHUNKS, PAGES, conform

#: Columns of a chunk whose difference makes it an update.
COMPARED = ("text", "url", "ordinal", "anchor", "heading_path", "title")


@dataclass
class Loaded:
    """The corpus after a load, and one row of counts: pages, chunks (of the batch), inserted, updated, deleted."""

    pages: DataFrame
    chunks: DataFrame
    counts: DataFrame


def load(pages: DataFrame, chunks: DataFrame, batch: DataFrame, version: str = "", fetched_at: str = "", last_seq: int = -1) -> Loaded:
    """Upsert ``batch`` (chunks). Repeats within the batch count once (the greatest text wins); null ids and urls are left out.

    load_seq keeps the order of first insertion: old rows keep theirs, new ones follow in (url, ordinal) order
    without being collected: the number is the old maximum, at least ``last_seq``, plus a monotonic id.
    """
    old_pages, old = conform(pages, PAGES), conform(chunks, CHUNKS)
    new = conform(batch, CHUNKS).where("chunk_id IS NOT NULL AND url IS NOT NULL")
    new = new.groupBy("chunk_id").agg(F.max(F.struct(F.coalesce("text", F.lit("")).alias("_t"), *[F.col(c) for c in new.columns if c != "chunk_id"])).alias("s")).select("chunk_id", *[F.col(f"s.{c}").alias(c) for c in new.columns if c != "chunk_id"])
    urls = new.select("url").distinct()

    before = old.select("chunk_id", F.col("load_seq").alias("_seq"), *[F.col(c).alias(f"_o_{c}") for c in COMPARED])
    joined = new.join(before, "chunk_id", "left")
    changed = F.lit(False)
    for c in COMPARED:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    top = old.agg(F.greatest(F.coalesce(F.max("load_seq"), F.lit(-1)), F.lit(last_seq)).alias("_top"))
    state = joined.withColumn("change", F.when(F.col("_seq").isNull(), "inserted").when(changed, "updated").otherwise("same"))
    ordered = state.where("change = 'inserted'").repartitionByRange("url", "ordinal").sortWithinPartitions("url", "ordinal", "chunk_id").crossJoin(F.broadcast(top))
    # written, as the ranges come from a sample: read twice, the numbers would differ
    fresh = materialize(ordered.withColumn("load_seq", F.col("_top") + 1 + F.monotonically_increasing_id()).select(*old.columns), "fresh")
    # a chunk that differs in nothing compared stays as it was, tokens and hash included
    kept_same = old.join(state.where("change = 'same'").select("chunk_id"), "chunk_id", "left_semi")
    replaced = state.where("change = 'updated'").withColumn("load_seq", F.col("_seq")).select(*old.columns)
    others = old.join(urls, "url", "left_anti").join(new.select("chunk_id"), "chunk_id", "left_anti")
    gone = old.join(urls, "url", "left_semi").join(new.select("chunk_id"), "chunk_id", "left_anti")
    out = others.unionByName(kept_same.select(*old.columns)).unionByName(replaced).unionByName(fresh)

    first = new.groupBy("url").agg(F.min_by("title", F.struct("ordinal", "chunk_id")).alias("title"), F.count(F.lit(1)).cast("int").alias("n_chunks"))
    was = old_pages.groupBy("url").agg(F.max("canonical_url").alias("canonical_url"), F.max("status").alias("status"))
    rows = first.join(was, "url", "left").select(
        "url", F.coalesce("title", F.lit("")).alias("title"), source_of_url("url").alias("source"), F.lit(version).alias("version"), F.lit(fetched_at).alias("fetched_at"), "n_chunks",
        F.coalesce("canonical_url", F.lit("")).alias("canonical_url"), F.coalesce("status", F.lit("ok")).alias("status"),
    )
    all_pages = old_pages.join(urls, "url", "left_anti").unionByName(rows)
    n = state.agg(F.count_distinct("url").alias("pages"), F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("change") == "inserted").alias("inserted"), F.count_if(F.col("change") == "updated").alias("updated"))
    return Loaded(all_pages, out, n.crossJoin(gone.agg(F.count(F.lit(1)).alias("deleted"))))


def get(chunks: DataFrame, chunk_id: str) -> DataFrame:
    """The rows of one chunk; the filter reaches the scan."""
    return chunks.where(F.col("chunk_id") == chunk_id)


def counts(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: chunks and pages."""
    return chunks.agg(F.count(F.lit(1)).alias("chunks")).crossJoin(pages.agg(F.count(F.lit(1)).alias("pages")))


def iter_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.orderBy("url", "ordinal", "chunk_id")


def chunk_ids(chunks: DataFrame) -> DataFrame:
    """Ids in the order of insertion."""
    return chunks.orderBy("load_seq", "chunk_id").select("chunk_id")


def locate(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, url, anchor of the ids that exist, each once."""
    places = chunks.groupBy("chunk_id").agg(F.min(F.struct("url", F.coalesce("anchor", F.lit("")).alias("anchor"))).alias("s"))
    return ids.select("chunk_id").distinct().join(places, "chunk_id").select("chunk_id", "s.url", "s.anchor")


def section_index(chunks: DataFrame) -> DataFrame:
    """Chunks with their number within (url, heading_path), from 0, in order of ordinal."""
    return chunks.withColumn("section_no", F.row_number().over(W.partitionBy("url", "heading_path").orderBy("ordinal", "chunk_id")) - 1)
