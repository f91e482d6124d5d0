"""The k most similar vectors of every vector, by an inverted multi-index.

Each vector's two halves are quantised by codebooks of their own, so a pair of centroids names a
cell. A query walks the pairs in the order of their summed distances with a heap until the cells
passed hold enough vectors; the entries of these cells are reranked by exact cosine. Codebooks are
fitted on a bounded sample; every vector is indexed and every vector is a query.

Sizes: with N distinct vectors a codebook has about N^(1/4) centroids and a query sees about
``REACH`` N^(1/2) entries, so work grows as N^1.5. Copies of a vector are one entry. Cells are cut
into blocks of bounded size, on the entry and on the query side, so no task holds a whole hot cell.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ranking import ranges, top_n
from ..plans.shared import materialize

#: Most vectors that the codebooks are fitted on, and most centroids of a codebook.
TRAIN_ROWS, MOST_CENTROIDS = 20_000, 256
#: A query walks cells until they hold this times the root of the number of vectors.
REACH = 24
#: Most entries of a block, and about the most queries against it at a time.
BLOCK_ROWS, QUERY_ROWS = 4096, 8192
#: Candidates kept beyond k in a block: room for items with several vectors. Ties need none, they are cut by item.
SPARE = 3
#: More than any error of a cosine in single precision, and entries that near to the last place from which all are taken in double.
NOISE, MANY = 1e-5, 64


def train_codebook(half: np.ndarray, k: int) -> np.ndarray:
    """Up to ``k`` centroids: the most populous group is split in two until there are k, then a few Lloyd steps.

    Splitting by population keeps a dense spot from sharing one centroid, which uneven densities need.
    """
    groups = [np.arange(len(half))]
    heap = [(-len(half), 0)]
    while len(heap) < k and heap and -heap[0][0] > 1:
        _, at = heapq.heappop(heap)
        x = half[groups[at]]
        b = x[((x - x[0]) ** 2).sum(1).argmax()]
        a = x[((x - b) ** 2).sum(1).argmax()]
        side = None
        for _ in range(8):
            side = x @ (b - a) > (b - a) @ ((a + b) / 2)
            if side.all() or not side.any():
                break
            a, b = x[~side].mean(0), x[side].mean(0)
        if side.all() or not side.any():
            heapq.heappush(heap, (0, at))  # all alike
            continue
        groups.append(groups[at][side])
        groups[at] = groups[at][~side]
        heapq.heappush(heap, (-len(groups[at]), at))
        heapq.heappush(heap, (-len(groups[-1]), len(groups) - 1))
    centroids = np.stack([half[g].mean(0) for g in groups])
    for _ in range(4):
        near = distances(half, centroids).argmin(1)
        for i in range(len(centroids)):
            if (near == i).any():
                centroids[i] = half[near == i].mean(0)
    return centroids.astype(np.float32)


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x**2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids**2).sum(1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Non-empty cells in the order of first[i] + second[j], until they hold ``enough`` entries.

    The multi-sequence walk: the heap holds the frontier over the two sorted distance lists.
    """
    a, b = np.argsort(first, kind="stable").tolist(), np.argsort(second, kind="stable").tolist()
    da, db = [float(first[i]) for i in a], [float(second[j]) for j in b]
    width, cells, held = len(b), [], 0
    heap, reached = [(da[0] + db[0], 0, 0)], {0}
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = a[i] * width + b[j]
        n = counts[cell]
        if n:
            cells.append(cell)
            held += n
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < width and x * width + y not in reached:
                reached.add(x * width + y)
                heapq.heappush(heap, (da[x] + db[y], x, y))
    return cells


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def best(queries: np.ndarray, query_ids: np.ndarray, entries: np.ndarray, entry_ids: np.ndarray, keep: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query its ``keep`` best entries other than itself and not under ``least``: query row, entry id, cosine.

    Unit vectors in double. Single precision passes over what is clearly too far; the rest goes by the cosine in
    double, rounded to 9 decimals, and ties by the smaller id.
    """
    rows, ids, values = [], [], []
    order = np.argsort(entry_ids)
    entries, entry_ids = entries[order], entry_ids[order]
    entries32 = entries.astype(np.float32).T

    def add(r: np.ndarray, c: np.ndarray, cos: np.ndarray) -> None:
        rows.append(r)
        ids.append(entry_ids[c])
        values.append(cos)

    for at in range(0, len(queries), 1024):
        q, own = queries[at : at + 1024], query_ids[at : at + 1024, None] == entry_ids[None, :]
        s = q.astype(np.float32) @ entries32
        s[own] = -3
        bar = least[at : at + 1024]
        if s.shape[1] > keep:
            bar = np.maximum(bar, np.partition(s, s.shape[1] - keep, axis=1)[:, -keep])
        near = (s > -2) & (s >= bar[:, None] - NOISE)
        many = near.sum(1) > max(MANY, keep)
        r, c = np.nonzero(near & ~many[:, None])
        cos = np.round(np.einsum("ij,ij->i", q[r], entries[c]), 9)
        order = np.lexsort((c, -cos, r))
        r, c, cos = r[order], c[order], cos[order]
        first = np.arange(len(r)) - np.searchsorted(r, r) < keep
        add(r[first] + at, c[first], cos[first])
        if many.any():  # a dense spot, in which single precision tells nothing
            x = np.round(q[many] @ entries.T, 9)
            x[own[many]] = -3
            last = np.partition(x, x.shape[1] - keep, axis=1)[:, -keep, None]
            above, tied = x > last, x == last
            r, c = np.nonzero(above | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= keep - above.sum(1, keepdims=True))))
            add(np.flatnonzero(many)[r] + at, c, x[r, c])
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(values)


def directions(rows: DataFrame, dim: int) -> DataFrame:
    """item, v, h, g of the usable rows: vectors of ``dim`` finite values, not all zero.

    h and g are 128 bits of hash of the vector's direction: copies of a vector, and those scaled without rounding, are one class.
    """

    def run(batches):
        import xxhash

        for batch in batches:
            lists = batch.column(1)
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(lists), dim), False))
            x = matrix(batch.column(1), dim)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            batch, x = batch.filter(pa.array(good)), x[good].astype(np.float64)
            if len(x):
                x = x / np.abs(x).max(1, keepdims=True) + 0.0  # no negative zeros
            digests = b"".join(xxhash.xxh3_128_digest(row.tobytes()) for row in x)
            h = np.frombuffer(digests, dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], names=["item", "v", "h", "g"])

    return rows.mapInArrow(run, "item string, v array<float>, h long, g long")


def nearest(vectors: DataFrame, k: int = 5, dim: int = 64, item: str = "chunk_id", vec: str = "vec", reach: float = REACH, train_rows: int = TRAIN_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """item, neighbour, rank (1..k), cosine (rounded to 9 decimals; ties by smaller item) for every usable vector.

    Not usable, and without rows: null vectors or items, vectors of another length, with null, NaN
    or infinite values, or all zero. Repeated rows count once; an item with several different
    vectors is as near as its nearest. Length does not matter. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    hashed = materialize(directions(vectors.select(F.col(item).cast("string").alias("item"), F.col(vec).cast("array<float>").alias("v")).where("item IS NOT NULL"), dim), "hashed")
    firsts = top_n(hashed.select("h", "g", "item").distinct(), ["h", "g"], [F.col("item")], k + 1).groupBy("h", "g").agg(F.array_sort(F.collect_list("item")).alias("items"))
    values = hashed.groupBy("h", "g").agg(F.first("v").alias("v"))
    classes = materialize(in_order(values.join(firsts, ["h", "g"])), "classes")
    n = classes.count()
    if n == 0:
        return spark.createDataFrame([], "item string, neighbour string, rank int, cosine double")
    sample = classes.where(F.pmod(F.xxhash64("vid", F.lit(3)), F.lit(n)) < train_rows).select("v").toArrow()
    train = unit(matrix(sample.column(0), dim))
    cut = dim // 2
    k_cells = max(1, min(MOST_CENTROIDS, round(n**0.25)))
    books = [train_codebook(train[:, :cut], k_cells), train_codebook(train[:, cut:], k_cells)] if len(train) else [np.zeros((1, cut), np.float32), np.zeros((1, dim - cut), np.float32)]
    width = len(books[1])

    def assign(batches):
        for batch in batches:
            x = unit(matrix(batch.column(1), dim))
            cell = distances(x[:, :cut], books[0]).argmin(1) * width + distances(x[:, cut:], books[1]).argmin(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, type=pa.int32())], names=["vid", "v", "cell"])

    assigned = materialize(classes.select("vid", "v").mapInArrow(assign, "vid long, v array<float>, cell int"), "assigned")
    counts = np.zeros(len(books[0]) * width, dtype=np.int64)
    for r in assigned.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # at most MOST_CENTROIDS squared
        counts[r["cell"]] = r["n"]
    blocks = np.maximum(1, -(-counts // block_rows))
    enough, keep = max(200, math.ceil(reach * math.sqrt(n))), k + SPARE

    def at_home(table: pa.Table) -> pa.Table:
        """Best of a vector's own block, and the cells that it still has to see."""
        x, ids, cell = unit(matrix(table.column("v"), dim)), table.column("vid").to_numpy(), table.column("cell")[0].as_py()
        row, cand, cos = best(x, ids, x, ids, keep, np.full(len(x), -2.0))
        order = np.lexsort((-cos, row))
        row, cand, cos = row[order], cand[order], cos[order]
        n_found = np.bincount(row, minlength=len(x))
        starts = np.concatenate([[0], np.cumsum(n_found)])
        kth = np.where(n_found > k, cos[np.minimum(starts[:-1] + k, max(len(cos) - 1, 0))] if len(cos) else -2.0, -2.0)
        first, second = distances(x[:, :cut], books[0]), distances(x[:, cut:], books[1])
        cells = [walk(first[i], second[i], counts, enough) for i in range(len(x))]
        cells = [c if blocks[cell] > 1 else [y for y in c if y != cell] for c in cells]
        offsets = lambda lengths: pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
        return pa.table(
            {
                "vid": table.column("vid"), "v": table.column("v"), "cell": table.column("cell"), "block": table.column("block"), "kth": pa.array(kth, type=pa.float64()),
                "cand": pa.ListArray.from_arrays(offsets(n_found), pa.array(cand, type=pa.int64())), "cos": pa.ListArray.from_arrays(offsets(n_found), pa.array(cos, type=pa.float64())),
                "cells": pa.ListArray.from_arrays(offsets([len(c) for c in cells]), pa.array([y for c in cells for y in c], type=pa.int32())),
            }
        )

    layout = F.broadcast(spark.createDataFrame([(int(c), int(blocks[c])) for c in np.nonzero(counts)[0]], "cell int, n_blocks int"))  # bounded by the codebooks
    entries = assigned.join(layout, "cell").select("vid", "v", "cell", F.pmod(F.xxhash64("vid"), F.col("n_blocks")).cast("int").alias("block"))
    home = materialize(entries.groupBy("cell", "block").applyInArrow(at_home, "vid long, v array<float>, cell int, block int, kth double, cand array<long>, cos array<double>, cells array<int>"), "home")

    asked = home.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    shares = F.broadcast(asked.select("cell", F.ceil(F.col("n") / QUERY_ROWS).cast("int").alias("shares")))  # bounded by the codebooks
    queries = (
        home.select("vid", "v", "kth", F.col("cell").alias("own"), F.col("block").alias("own_block"), F.explode("cells").alias("cell"))
        .join(layout, "cell").join(shares, "cell")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .where("NOT (cell = own AND block = own_block)")
        .select("vid", "v", "kth", "cell", "block", F.pmod(F.xxhash64("vid", F.lit(5)), F.col("shares")).cast("int").alias("share"))
    )
    spread = home.select(*[F.col(c).alias(f"e_{c}") for c in ("vid", "v", "cell", "block")]).join(shares.withColumnRenamed("cell", "e_cell"), "e_cell")
    spread = spread.select("e_vid", "e_v", "e_cell", "e_block", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("e_share"))

    def abroad(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"vid": pa.array([], pa.int64()), "cand": pa.array([], pa.int64()), "cos": pa.array([], pa.float64())})
        ids = left.column("vid").to_numpy()
        row, cand, cos = best(unit(matrix(left.column("v"), dim)), ids, unit(matrix(right.column("e_v"), dim)), right.column("e_vid").to_numpy(), keep, left.column("kth").to_numpy())
        return pa.table({"vid": pa.array(ids[row]), "cand": pa.array(cand), "cos": pa.array(cos)})

    key = ["cell", "block", "share"]
    far = queries.groupBy(*key).cogroup(spread.groupBy(*[f"e_{c}" for c in key])).applyInArrow(abroad, "vid long, cand long, cos double")
    near = home.select("vid", F.explode(F.arrays_zip("cand", "cos")).alias("z")).select("vid", "z.cand", "z.cos")
    found = top_n(near.unionByName(far), ["vid"], [F.col("cos").desc(), F.col("cand")], keep + SPARE)
    other = found.select("vid", F.col("cand"), F.round("cos", 9).alias("cos")).join(classes.select(F.col("vid").alias("cand"), "items"), "cand").select("vid", "cos", F.explode("items").alias("neighbour"))
    own = classes.select("vid", F.lit(1.0).alias("cos"), F.explode("items").alias("neighbour"))
    lists = top_n(other.unionByName(own).groupBy("vid", "neighbour").agg(F.max("cos").alias("cos")), ["vid"], [F.col("cos").desc(), F.col("neighbour")], k + 1)
    lists = lists.groupBy("vid").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour", "cos"))).alias("list"))
    per_class = classes.select("vid", "h", "g").join(lists, "vid").select("h", "g", "list")
    members = hashed.select("item", "h", "g").distinct().join(per_class, ["h", "g"])
    others = F.slice(F.filter("list", lambda s: s["neighbour"] != F.col("item")), 1, k)
    listed = members.select("item", F.posexplode(others).alias("at", "s")).select("item", F.col("s.neighbour").alias("neighbour"), (F.col("at") + 1).alias("rank"), F.col("s.cos").alias("cosine"))
    return listed


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double."""
    d = x.astype(np.float64)
    # the largest value goes first: squares of extreme single-precision values stay in range
    d /= np.abs(d).max(axis=1, keepdims=True) if len(d) else 1.0
    return d / np.sqrt((d**2).sum(1, keepdims=True))


def in_order(classes: DataFrame) -> DataFrame:
    """h, g, v, items and vid, numbers from 0 in the order of the smallest item, so that the smaller of two numbers wins a tie.

    The k best items of a query are then in its k best classes, however many classes tie.
    """
    key = ["first", "h", "g"]
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = ranges(classes.withColumn("first", F.col("items")[0]), key, "_range", parts, "ordered")
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    shifts = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*key)) - 1
    return cut.join(F.broadcast(shifts), "_range").select("h", "g", "v", "items", (F.col("_shift") + place).cast("long").alias("vid"))


def neighbour_pairs(listed: DataFrame) -> DataFrame:
    """chunk_id_a, chunk_id_b, smaller first: pairs in which one is in the other's list, once each."""
    a, b = F.least("item", "neighbour"), F.greatest("item", "neighbour")
    return listed.select(a.alias("chunk_id_a"), b.alias("chunk_id_b")).distinct()
