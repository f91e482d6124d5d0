"""Agreement of two ratings: confusion, Cohen's kappa, reproduction, Fisher's exact test."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRADES = (0, 1, 2)
#: Fixed value: tables whose probabilities are computed at once.
_BLOCK = 4096


def rating_pairs(entries: DataFrame, key: DataFrame) -> DataFrame:
    """id, original, regrade of the entries that were graded again and have a key."""
    return entries.where("grade IS NOT NULL").select("id", F.col("grade").alias("regrade")).join(key.select("id", "original"), "id").where("original IS NOT NULL")


def confusion(pairs: DataFrame, grades: Sequence[int] = GRADES) -> DataFrame:
    """original, g0, g1, ...: one row a grade, with zeros."""
    seen = pairs.groupBy("original").agg(*[F.count_if(F.col("regrade") == g).alias(f"g{g}") for g in grades])
    rows = pairs.sparkSession.createDataFrame([(g,) for g in grades], "original int")
    return rows.join(seen, "original", "left").na.fill(0)


def transition_counts(pairs: DataFrame, probe: str = "probe", source: dict[int, str] | None = None) -> DataFrame:
    """Re-grade counts with each original grade taken from the probe that ``source`` names."""
    if source:
        at = F.create_map(*[F.lit(x) for g, p in source.items() for x in (g, p)])
        pairs = pairs.where(at[F.col("original")] == F.col(probe))
    return confusion(pairs)


def kappa(pairs: DataFrame) -> DataFrame:
    """One row: n, kappa, observed, chance. No pairs give zeros; chance 1 gives kappa 0. Pairs with a null count not."""
    rows = pairs.where("original IS NOT NULL AND regrade IS NOT NULL")
    cells = rows.groupBy("original", "regrade").agg(F.count(F.lit(1)).cast("double").alias("c"))  # one row a pair of grades
    a = cells.groupBy(F.col("original").alias("g")).agg(F.sum("c").alias("a"))
    b = cells.groupBy(F.col("regrade").alias("g")).agg(F.sum("c").alias("b"))
    margins = a.join(b, "g").agg(F.sum(F.col("a") * F.col("b")).alias("m"))
    n = cells.agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("n"), F.coalesce(F.sum(F.when(F.col("original") == F.col("regrade"), F.col("c"))), F.lit(0.0)).alias("same"))
    both = n.crossJoin(margins).select(F.col("n").cast("long").alias("n"), F.coalesce(F.col("same") / F.nullif("n", F.lit(0.0)), F.lit(0.0)).alias("observed"), F.coalesce(F.col("m") / F.nullif(F.col("n") * F.col("n"), F.lit(0.0)), F.lit(0.0)).alias("chance"))
    k = F.when((F.col("n") == 0) | (F.col("chance") >= 1), F.lit(0.0)).otherwise((F.col("observed") - F.col("chance")) / (1 - F.col("chance")))
    return both.select("n", k.alias("kappa"), "observed", "chance")


def reproduction(pairs: DataFrame) -> DataFrame:
    """original, same, total, share of ratings given again."""
    return pairs.groupBy("original").agg(F.count_if(F.col("original") == F.col("regrade")).alias("same"), F.count(F.lit(1)).alias("total")).withColumn("share", F.col("same") / F.col("total"))


def _two_sided(a: int, b: int, c: int, d: int) -> float:
    """Fisher's two-sided p of one table. Each table's probability is taken relative to the likeliest one's and comes from its neighbour's by a ratio.

    Sides end where the relative probability is 0 as a double, so the work follows the square root of the counts and nothing that a sum of doubles holds is left out.
    """
    r1, r2, c1 = a + b, c + d, a + c
    if not (r1 and r2 and c1 and b + d):
        return 1.0
    low, high = max(0, c1 - r2), min(r1, c1)
    mode = min(high, max(low, (r1 + 1) * (c1 + 1) // (r1 + r2 + 2)))
    exact = lambda x: np.asarray(x, dtype=np.int64).astype(np.longdouble)
    weights = {}
    for up in (True, False):
        at, last, parts = mode, np.longdouble(1), []
        while last.astype(float) > 0 and (at < high if up else at > low):
            n = min(_BLOCK, high - at if up else at - low)
            if up:
                x = np.arange(at, at + n, dtype=np.int64)
                ratio = (exact(r1 - x) / exact(x + 1)) * (exact(c1 - x) / exact(r2 - c1 + x + 1))
            else:
                x = np.arange(at, at - n, -1, dtype=np.int64)
                ratio = (exact(x) / exact(r1 - x + 1)) * (exact(r2 - c1 + x) / exact(c1 - x + 1))
            parts.append(last * np.cumprod(ratio))
            last, at = parts[-1][-1], at + n if up else at - n
        weights[up] = parts
    up, down = (np.concatenate([*weights[side], np.zeros(0, np.longdouble)]) for side in (True, False))
    place = abs(a - mode) - 1
    side = up if a > mode else down
    seen = np.longdouble(1) if a == mode else side[place] if place < len(side) else np.longdouble(0)
    every = np.concatenate([np.ones(1, np.longdouble), up, down])
    return float(min(1, every[every <= seen * (1 + np.longdouble(1e-12))].sum() / every.sum()))


def fisher_exact(tables: DataFrame) -> DataFrame:
    """tables (a, b, c, d) with p_value: the two-sided test, summing tables no more likely than the one seen.

    An empty margin gives 1, a null count null. Values may be any non-negative counts.
    """

    @F.pandas_udf("double")
    def p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([_two_sided(*map(int, t)) for t in zip(a, b, c, d, strict=True)], dtype=float)

    counts = [F.coalesce(F.col(x).cast("long"), F.lit(0)) for x in "abcd"]
    return tables.withColumn("p_value", F.when(F.greatest(*[F.col(x).isNull() for x in "abcd"]), F.lit(None)).otherwise(p(*counts)))
