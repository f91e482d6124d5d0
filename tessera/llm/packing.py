"""Filling containers of fixed capacity: a plan over the histogram of lengths, then documents take slots.

The plan is best fit, longest first, over counts: a length with a million documents is placed in a
few steps, each filling many equal containers at once. Lengths run from 1 to the capacity, so the
histogram and the plan are bounded by the capacity, not by the corpus; only they reach the driver.
Documents are then numbered within their length and joined to the planned slots on (length, rank).
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranking import position_by_bucket
from ..plans.shared import materialize
from .bpe import TOKENIZER_DIR, count_tokens

CAPACITY = 2048
#: Slots of one plan row that one row of the exploded plan may make.
SLOT_BLOCK = 50_000


@dataclass
class Bins:
    """``count`` equal containers: what they hold, as (length, items), and the space left in each."""

    holds: tuple[tuple[int, int], ...]
    count: int
    left: int


def plan(histogram: dict[int, int], capacity: int) -> list[Bins]:
    """Best fit over counts, longest first.

    Each length goes to the open containers with the least space that still takes it, as many to a
    container as fit, before new ones are opened. Every step but the last of a length uses up a whole
    group of equal containers, so there are at most three groups a length.
    """
    open_by_left: dict[int, list[Bins]] = {}
    lefts: list[int] = []

    def add(bins: Bins) -> None:
        if bins.count:
            if bins.left not in open_by_left:
                open_by_left[bins.left] = []
                bisect.insort(lefts, bins.left)
            open_by_left[bins.left].append(bins)

    for length in sorted(histogram, reverse=True):
        todo = histogram[length]
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not in 1..{capacity}")
        while todo:
            at = bisect.bisect_left(lefts, length)
            if at < len(lefts):
                group = open_by_left[lefts[at]].pop()
                if not open_by_left[lefts[at]]:
                    del open_by_left[lefts[at]]
                    del lefts[at]
            else:
                group = Bins((), todo, capacity)
            each = group.left // length
            full = min(group.count, todo // each)
            rest = todo - full * each if full < group.count else 0
            add(Bins((*group.holds, (length, each)), full, group.left - each * length))
            if rest:
                add(Bins((*group.holds, (length, rest)), 1, group.left - rest * length))
            if group.holds:
                add(Bins(group.holds, group.count - full - bool(rest), group.left))
            todo -= full * each + rest
    return [b for left in lefts for b in open_by_left[left]]


def slots(spark, bins: list[Bins]) -> DataFrame:
    """One row a slot: length, rank within the length from 0, container_id. The plan rows are exploded in blocks by the executors."""
    rows, start, used = [], 0, {}
    for b in bins:
        for length, each in b.holds:
            first, n = used.get(length, 0), b.count * each
            rows += [(length, first + i, min(SLOT_BLOCK, n - i), start, i, each) for i in range(0, n, SLOT_BLOCK)]
            used[length] = first + n
        start += b.count
    plan_rows = spark.createDataFrame(rows, "length int, first long, n long, container long, done long, each long").repartition(max(1, min(200, len(rows) // 50)))
    return plan_rows.select("length", "first", "container", "done", "each", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i")).select(
        "length", (F.col("first") + F.col("i")).alias("rank"), (F.col("container") + ((F.col("done") + F.col("i")) / F.col("each")).cast("long")).alias("container_id")
    )


def pack(documents: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """Containers of at most ``capacity`` tokens: container_id, doc_id, piece_no, token_start, n_tokens.

    Only a text above the capacity is cut, into full pieces and a rest; null and empty texts are
    left out. Repeated rows are packed each; a null id stays null. An empty table gives no rows.
    """
    counted = count_tokens(documents, text=text, tokenizer=tokenizer, folder=folder, keep=(doc_id,)).where(F.col("n_tokens") > 0)
    whole = F.explode(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int")))
    pieces = counted.select(doc_id, "n_tokens", whole.alias("piece_no")).select(
        doc_id, "piece_no", (F.col("piece_no") * capacity).alias("token_start"), F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece_no") * capacity).cast("int").alias("length")
    )
    # the row's number spreads repeated and null ids
    pieces = materialize(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranked = position_by_bucket(pieces, ["length"], [doc_id, "piece_no", "_row"], "rank")
    return ranked.join(slots(documents.sparkSession, plan(histogram, capacity)), ["length", "rank"]).select("container_id", doc_id, "piece_no", "token_start", F.col("length").alias("n_tokens"))


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, the least containers that the tokens need, and the share of space used."""
    used = packed.groupBy("container_id").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"))
    return used.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("items").alias("n_items"), F.sum("tokens").alias("n_tokens"), F.ceil(F.sum("tokens") / capacity).alias("least_containers"),
        F.max("tokens").alias("fullest"), F.round(F.sum("tokens") / (F.count(F.lit(1)) * capacity), 6).alias("used_share"),
    )
