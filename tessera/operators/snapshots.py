"""What changed between consecutive full snapshots, by content-defined chunks of the key order.

Each snapshot is put in key order and cut where the key's hash says so, so that equal stretches of
two snapshots are cut alike however much was inserted before them. A chunk's digest covers its
keys and hashes; chunks found in both snapshots are discarded, and only rows of the rest are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ranking import ranges

#: A key begins a chunk when its hash is 0 modulo this: the mean number of rows of a chunk.
CHUNK_ROWS = 32
#: Digits of a hash that count.
HASH_DIGITS = 16


def compact(column: Column) -> Column:
    """Lower case without white space; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(column), r"[\s ]+", ""), F.lit(""))


def latest_rows(snapshots: DataFrame) -> DataFrame:
    """snapshot_id, chunk_id, hash: of several rows of a chunk in a snapshot the one with the latest instant in fetched_at.

    An unreadable or null instant is earliest; equal instants fall to the later loaded_at, then the
    greater hash. A hash is the last 16 characters of content_hash in lower case without blanks,
    null if unknown. Rows without snapshot_id or chunk_id are left out. Aggregated before the
    shuffle, so copies of one key cost a row a task.
    """
    h = compact(F.col("content_hash"))
    instant = F.expr("try_to_timestamp(trim(fetched_at))")
    order = F.struct(F.coalesce(F.unix_micros(instant), F.lit(-(2**62))).alias("a"), F.coalesce(F.unix_micros("loaded_at"), F.lit(-(2**62))).alias("b"), F.coalesce(h, F.lit("")).alias("c"))
    rows = snapshots.select(F.col("snapshot_id"), compact(F.col("chunk_id")).alias("chunk_id"), F.substring(h, -HASH_DIGITS, HASH_DIGITS).alias("hash"), order.alias("_order"))
    rows = rows.where("snapshot_id IS NOT NULL AND chunk_id IS NOT NULL")
    return rows.groupBy("snapshot_id", "chunk_id").agg(F.max(F.struct("_order", "hash")).alias("_best")).select("snapshot_id", "chunk_id", F.col("_best.hash").alias("hash"))


def snapshot_changes(snapshots: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """snapshot_id, chunk_id, change_kind ('added', 'removed', 'changed') against the snapshot before; none for the first.

    Snapshots follow in the order of snapshot_id. A chunk is changed if both hashes are known and
    differ. An empty table gives no rows; columns not named here are ignored.
    """
    spark = snapshots.sparkSession
    rows = ranges(latest_rows(snapshots), ["chunk_id"], "_range", int(spark.conf.get("spark.sql.shuffle.partitions")), "snapshots")
    names = rows.select("snapshot_id").distinct().withColumn("_no", F.row_number().over(W.orderBy("snapshot_id")))
    rows = rows.join(names, "snapshot_id")
    starts = F.when(F.pmod(F.xxhash64("chunk_id"), F.lit(chunk_rows)) == 0, F.col("chunk_id"))
    key_order = W.partitionBy("_no", "_range").orderBy("chunk_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    cut = rows.withColumn("_start", F.coalesce(F.last(starts, True).over(key_order), F.lit("")))
    row_digest = F.xxhash64("chunk_id", "hash", F.lit(17))
    digests = cut.groupBy("_no", "_range", "_start").agg(F.count(F.lit(1)).alias("_n"), F.bit_xor(F.xxhash64("chunk_id", "hash")).alias("_x"), F.sum(row_digest.cast("decimal(38,0)")).alias("_s"))
    # a chunk is known to its successor, and the other way round, by the same start and digest
    a, b = digests.alias("a"), digests.withColumn("_no", F.col("_no") - 1).alias("b")
    same = a.join(b, ["_no", "_range", "_start", "_n", "_x", "_s"]).select("_no", "_range", "_start")
    old = cut.join(same, ["_no", "_range", "_start"], "left_anti").select((F.col("_no") + 1).alias("_no"), "chunk_id", F.col("hash").alias("_old"), F.lit(True).alias("_was"))
    new = cut.join(same.withColumn("_no", F.col("_no") + 1), ["_no", "_range", "_start"], "left_anti").select("_no", "chunk_id", F.col("hash").alias("_new"), F.lit(True).alias("_is"))
    kind = F.when(F.col("_was").isNull(), F.lit("added")).when(F.col("_is").isNull(), F.lit("removed")).when(F.col("_old") != F.col("_new"), F.lit("changed"))
    both = old.join(new, ["_no", "chunk_id"], "full_outer").withColumn("change_kind", kind).where("change_kind IS NOT NULL AND _no > 1")
    return both.join(names, "_no").select("snapshot_id", "chunk_id", "change_kind")
