"""Row numbers within groups of any size, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialize


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank.

    Spark's window group limit cuts every group to ``n`` rows in each input partition before the
    shuffle, so a hot group costs at most ``n`` rows a partition.
    """
    w = W.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def position_by_bucket(df: DataFrame, by: Sequence[str], key: Sequence[str], position: str, buckets: int | None = None) -> DataFrame:
    """Number the rows of each group from 0, in an order that is fixed but otherwise arbitrary.

    ``key`` must be unique within a group. Each group is cut into ``buckets`` (by default as many as there are shuffle partitions, at least 256) by the hash of the
    key; rows are numbered within (group, bucket) and shifted by the sizes of the buckets before.
    No task sees more of a group than one bucket, and the bucket is a function of the row, so a
    repeated task gives the same numbers. Null group values form a group.
    """
    b = "_bucket"
    buckets = buckets or max(256, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.withColumn(b, F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    sizes = rows.groupBy(*by, b).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(*[F.col(c).alias(f"_s_{c}") for c in by], F.col(b).alias("_s_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inner = W.partitionBy(*by, b).orderBy(*key)
    numbered = rows.withColumn("_rn", F.row_number().over(inner) - 1)
    same = F.col(b) == F.col("_s_b")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_s_{c}"))
    return (
        numbered.join(shifts, same)
        .withColumn(position, (F.col("_shift") + F.col("_rn")).cast("long"))
        .drop(b, "_rn", "_shift", "_s_b", *[f"_s_{c}" for c in by])
    )


def ranges(df: DataFrame, keys: Sequence[str], bucket: str, partitions: int, name: str) -> DataFrame:
    """``df`` cut into ranges of ``keys`` numbered in ``bucket`` in the order of the keys, written once.

    The ranges come from a sample, so the numbering is only fixed once written.
    """
    return materialize(df.repartitionByRange(partitions, *keys).withColumn(bucket, F.spark_partition_id()), name)


def place_by_key(df: DataFrame, by: Sequence[str], key: str, place: str = "place", size: str = "list_size", partitions: int | None = None) -> DataFrame:
    """Competition rank (1, 2, 2, 4) of each row in its group by ascending ``key``, and the group's number of rows.

    Rows are first counted by (group, key), so equal keys cost one row; the counted keys are cut
    into ranges, summed within a range and shifted by the ranges before. A group of any size is
    thus ranked by many tasks.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n"))
    cut = ranges(counted, [*by, key], "_range", parts, "places")
    totals = cut.groupBy(*by, "_range").agg(F.sum("_n").alias("_sum"))
    before = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = totals.select(*by, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_shift"), F.sum("_sum").over(W.partitionBy(*by)).alias(size))
    inside = W.partitionBy(*by, "_range").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    placed = cut.withColumn("_in", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    placed = placed.join(shifts, [*by, "_range"]).select(*by, key, (F.col("_shift") + F.col("_in") + 1).cast("long").alias(place), size)
    return df.join(placed, [*by, key])
