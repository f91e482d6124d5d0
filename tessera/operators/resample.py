"""Bootstrap intervals: paired systems under re-drawn judgments, and ratios of sums.

The judged queries are cut into blocks and the draws into ranges; a task makes a range of draws for one block and gives
sums, so no judgments are collected or broadcast and there is no limit on their number. What a draw shares, its
re-grade matrix and how many queries fall to each block, comes from a generator seeded by (seed, draw) in every task; what is
a block's own from one seeded by (seed, draw, block). Results don't depend on partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize

#: Draws and seed of the paired and the ratio bootstrap.
DRAWS, SEED, RATIO_SEED = 4000, 20260908, 0
METRICS = ("recall_5", "recall_5_share", "recall_10", "recall_10_share", "mrr", "ndcg_10")
#: Judgments of a block, about.
BLOCK_JUDGMENTS = 200_000
_DISCOUNT = np.concatenate([[0.0], np.cumsum(1 / np.log2(np.arange(2, 12)))])


def paired_draws(run: DataFrame, qrels: DataFrame, queries: DataFrame, transitions: DataFrame, draws: int = DRAWS, seed: int = SEED, block_judgments: int = BLOCK_JUDGMENTS) -> DataFrame:
    """draw, system, category ('all' too), metric, value.

    In each draw the rows of the re-grade matrix are drawn from a Dirichlet over ``transitions`` (original, g0,
    g1, g2) plus one, every judgment is re-graded once for all systems, and queries are resampled once a group for
    all systems, so differences stay paired. How many of a group's draws fall to each block is multinomial, which makes resampling within
    blocks the same as over all queries. Shares of the ceiling skip queries without a relevant unit.
    """
    spark = run.sparkSession
    judged = qrels.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("unit", "grade"))).alias("judged"))
    listed = run.join(qrels.select("query_id", "unit").distinct(), ["query_id", "unit"]).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("system", "rank", "unit"))).alias("listed"))
    n_blocks = max(1, -(-qrels.count() // block_judgments))
    asked = queries.select("query_id", F.coalesce("category", F.lit("?")).alias("category")).join(judged, "query_id").join(listed, "query_id", "left")
    asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int")), "judged")
    systems = sorted(r["system"] for r in run.where("system IS NOT NULL").select("system").distinct().collect())  # a handful
    sizes: dict[str, np.ndarray] = {"all": np.zeros(n_blocks, np.int64)}
    for r in sorted(asked.groupBy("block", "category").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: (r["category"], r["block"])):  # blocks times categories
        for name in ("all", r["category"]):
            sizes.setdefault(name, np.zeros(n_blocks, np.int64))[r["block"]] += r["n"]
    base = np.zeros((3, 3))
    for r in transitions.collect():  # three rows
        base[int(r["original"])] = [r["g0"], r["g1"], r["g2"]]
    ranges = max(1, min(draws, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def some(table: pa.Table) -> pa.Table:
        block, part = table.column("block")[0].as_py(), table.column("part")[0].as_py()
        rows = sorted(table.select(["query_id", "category", "judged", "listed"]).to_pylist(), key=lambda r: r["query_id"])
        q_key = np.repeat(np.arange(len(rows)), [len(r["judged"]) for r in rows])
        grade = np.array([j["grade"] for r in rows for j in r["judged"]], np.int64)
        place = {(i, u): n for n, (i, u) in enumerate((i, j["unit"]) for i, r in enumerate(rows) for j in r["judged"])}
        hits = [(x["system"], place[i, x["unit"]], x["rank"]) for i, r in enumerate(rows) for x in r["listed"] or []]
        runs = [(np.array([k for s, k, _ in hits if s == name], np.int64), np.array([r for s, _, r in hits if s == name], np.int64)) for name in systems]
        members = [np.array([i for i, r in enumerate(rows) if name in ("all", r["category"])], np.int64) for name in sizes]
        out: list[tuple] = []
        for draw in range(part * draws // ranges, (part + 1) * draws // ranges):
            shared, own = np.random.default_rng([seed, draw]), np.random.default_rng([seed, draw, block + 1])
            steps = np.stack([shared.dirichlet(row + 1.0) for row in base]).cumsum(1)
            quota = [shared.multinomial(n.sum(), n / n.sum())[block] for n in sizes.values()]
            regraded = np.minimum((own.random(len(grade))[:, None] > steps[grade]).sum(1), 2)
            of = [scores_of(*r, regraded, q_key, len(rows)) for r in runs]
            # systems x metrics x queries, and how often each group draws each query: one product gives all sums
            values = np.array([[scores[m] for m in METRICS] for scores in of]).reshape(len(systems), len(METRICS), len(rows))
            times = np.stack([np.bincount(at[own.integers(0, len(at), n)], minlength=len(rows)) if len(at) else np.zeros(len(rows)) for at, n in zip(members, quota)])
            known = ~np.isnan(values)
            out.append((np.where(known, values, 0.0) @ times.T, known.astype(float) @ times.T))
        total, weight = (np.stack([o[i] for o in out]) if out else np.zeros((0, len(systems), len(METRICS), len(sizes))) for i in (0, 1))
        d, s, m, g = (x.ravel() for x in np.indices(total.shape))
        pick = lambda labels, at: pa.array(list(labels), pa.string()).take(pa.array(at))
        return pa.table({"draw": pa.array(d + part * draws // ranges, pa.int64()), "system": pick(systems, s), "category": pick(sizes, g), "metric": pick(METRICS, m), "total": pa.array(total.ravel()), "weight": pa.array(weight.ravel())})

    spread = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))
    sums = spread.groupBy("block", "part").applyInArrow(some, "draw long, system string, category string, metric string, total double, weight double")
    out = sums.groupBy("draw", "system", "category", "metric").agg(F.sum("total").alias("t"), F.sum("weight").alias("w"))
    return out.select("draw", "system", "category", "metric", F.when(F.col("w") > 0, F.col("t") / F.col("w")).otherwise(0.0).alias("value"))


def scores_of(key: np.ndarray, rank: np.ndarray, grade: np.ndarray, q_key: np.ndarray, n_q: int) -> dict[str, np.ndarray]:
    """The six metrics of every query for one assignment of grades; shares are NaN where nothing is relevant."""
    relevant = np.bincount(q_key, grade > 0, n_q)
    best = np.bincount(q_key, grade == 2, n_q).astype(int)
    g, q = grade[key], q_key[key]
    hit = g > 0
    out = {}
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in (5, 10):
            found = np.bincount(q[hit & (rank <= k)], minlength=n_q) / relevant
            out[f"recall_{k}"] = np.nan_to_num(found)
            out[f"recall_{k}_share"] = np.where(relevant > 0, found / (np.minimum(k, relevant) / relevant), np.nan)
        first = np.full(n_q, np.inf)
        np.minimum.at(first, q[hit], rank[hit])
        out["mrr"] = 1 / first
        top = hit & (rank <= 10)
        dcg = np.bincount(q[top], (2.0 ** g[top] - 1) / np.log2(rank[top] + 1), n_q)
        a, b = np.minimum(best, 10), np.minimum(relevant.astype(int), 10)
        ideal = 3 * _DISCOUNT[a] + (_DISCOUNT[b] - _DISCOUNT[a])
        out["ndcg_10"] = np.nan_to_num(dcg / ideal)
    return out


def intervals(draws: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """by, low, mid, high: the 2.5, 50 and 97.5 percentiles, interpolated."""
    return draws.groupBy(*by).agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("_p")).select(*by, F.col("_p")[0].alias("low"), F.col("_p")[1].alias("mid"), F.col("_p")[2].alias("high"))


def paired_intervals(draws: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """a, b, category, metric, low, mid, high, decided: intervals of the difference a - b within a draw; decided if 0 is outside."""
    spark = draws.sparkSession
    key = ["draw", "category", "metric"]
    names = spark.createDataFrame(pairs, "a string, b string")
    left = draws.withColumnsRenamed({"system": "a", "value": "_a"}).join(names, "a")
    both = left.join(draws.withColumnsRenamed({"system": "b", "value": "_b"}), [*key, "b"])
    out = intervals(both.withColumn("value", F.col("_a") - F.col("_b")), ["a", "b", "category", "metric"])
    return out.withColumn("decided", (F.col("low") > 0) | (F.col("high") < 0))


def ratio_draws(rows: DataFrame, by: str, draws: int = DRAWS, seed: int = RATIO_SEED, part: str = "supported", total: str = "total") -> DataFrame:
    """by, draw, ratio: sums resampled over any number of rows, by Poisson weights.

    Equal rows are counted first; n of them take part in a draw with a Poisson(n) weight, which is what n
    independent Poisson(1) weights add up to. Weights come from a generator seeded by the seed and the row's values, so results don't depend on
    partitions. Sums are made in Arrow batches; only (group, draw) sums are shuffled.
    """
    counted = rows.groupBy(F.col(by).cast("string").alias("g"), F.col(part).cast("double").alias("p"), F.col(total).cast("double").alias("t")).agg(F.count(F.lit(1)).alias("n"))
    keyed = counted.withColumn("key", F.xxhash64(F.lit(seed), "g", "p", "t"))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            p, t, n, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4))
            for i, name in enumerate(batch.column(0).to_pylist()):
                w = np.random.default_rng(int(key[i]) % 2**63).poisson(n[i], draws)
                sums.setdefault(name, np.zeros((2, draws)))
                sums[name] += w * np.array([[p[i]], [t[i]]])
        for name, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * draws, pa.string()), pa.array(np.arange(draws), pa.int32()), pa.array(s[0]), pa.array(s[1])], names=["g", "draw", "p", "t"])

    out = keyed.mapInArrow(run, "g string, draw int, p double, t double").groupBy("g", "draw").agg(F.sum("p").alias("p"), F.sum("t").alias("t"))
    return out.where("t > 0").select(F.col("g").alias(by), "draw", (F.col("p") / F.col("t")).alias("ratio"))


def ratio_intervals(draws_: DataFrame, by: str) -> DataFrame:
    """by, low, high by index floor(q n) of the sorted ratios, without interpolation. A group has at most as many ratios as draws."""
    at = lambda q: F.element_at(F.col("_r"), (F.floor(F.lit(q) * F.size("_r")) + 1).cast("int"))
    return draws_.groupBy(by).agg(F.sort_array(F.collect_list("ratio")).alias("_r")).select(by, at(0.025).alias("low"), at(0.975).alias("high"))
