"""Dense index and exact cosine search of a table of queries against a table of vectors.

A bounded query side is sent to the vectors, each block of it is multiplied with the vectors of a
partition, and only the best of each partition is shuffled. Encoders are injected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from ..functions.text import embedding_text
from ..plans.ranking import top_n
from ..plans.shared import materialize
from . import fusion

#: Fixed value: least pool that is ranked before stubs and aliases are dropped.
POOL = 500
#: Queries multiplied with a partition's vectors at a time, and vectors of a block.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192
#: Bytes of query vectors (doubles) that are sent to all tasks at most.
SENT_BYTES = 64 * 2**20

#: Texts and whether they are queries, to one vector a row.
Encoder = Callable[[pd.Series, bool], "pd.Series"]


def encode(rows: DataFrame, encoder: Encoder | None = None, title: str = "title", path: str = "heading_path", text: str = "text", item: str = "chunk_id", is_query: bool = False) -> DataFrame:
    """item, vec: the vector at length 1 of every row's title, headings and text.

    The encoder runs in Arrow batches; the default is the hashing stand-in.
    """
    full = rows.select(item, embedding_text(title, path, text).alias("full"))
    encoder = encoder or vectors.hash_vectors

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return encoder(texts, is_query)

    return full.select(item, run("full").alias("vec")).select(item, vectors.normalized("vec").cast("array<float>").alias("vec"))


def index_stats(index: DataFrame, dim: int) -> DataFrame:
    """Vectors, dimension and bytes of the matrix."""
    return index.agg(F.count(F.lit(1)).alias("n_vectors")).select("n_vectors", F.lit(dim).alias("dim"), (F.col("n_vectors") * dim * 4).alias("matrix_bytes"))


def fingerprint(chunks: DataFrame, item: str = "chunk_id", content: str = "content_hash") -> DataFrame:
    """One row that changes whenever an item or its content does; the order of rows doesn't matter.

    Row hashes are summed, so no list of all rows is built.
    """
    h = F.sha2(F.concat(F.coalesce(item, F.lit("")), F.lit("\0"), F.coalesce(content, F.lit(""))), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)"))
    return chunks.agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *[part(i).cast("string") for i in range(4)]), 256).alias("fingerprint"))


def is_stale(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """One row: whether the stored fingerprint differs from that of the chunks."""
    return fingerprint(chunks).crossJoin(stored.select(F.col("fingerprint").alias("_stored"))).select((F.col("fingerprint") != F.col("_stored")).alias("stale"))


def search(queries: DataFrame, index: DataFrame, k: int, dim: int, query_id: str = "query_id", item: str = "chunk_id", vec: str = "vec", sent_bytes: int = SENT_BYTES) -> DataFrame:
    """query_id, rank, item, score: the ``k`` vectors of highest cosine (9 decimals; ties by smaller item).

    Vectors of another length, null or zero ones have no rank; repeated items count once, at their best.
    Queries whose vectors fit ``sent_bytes`` are sent to the vectors, which are read where they lie: each task keeps the ``k`` best items
    of a query and only these are shuffled. More queries are searched in blocks by hash, block against block.
    """
    spark = queries.sparkSession
    ok = lambda c: F.col(c).isNotNull() & (F.size(c) == dim) & F.exists(c, lambda x: x != 0)
    q = materialize(queries.select(F.col(query_id).alias("query_id"), F.col(vec).cast("array<float>").alias("qv")).where(ok("qv")), "queries")
    v = index.select(F.col(item).alias("item"), F.col(vec).cast("array<float>").alias("v")).where(ok("v") & F.col("item").isNotNull())
    kinds = f"query_id {q.schema['query_id'].dataType.simpleString()}, item {v.schema['item'].dataType.simpleString()}, score double"
    n = q.count()
    if not n or k < 1:
        return spark.createDataFrame([], kinds).withColumn("rank", F.lit(0)).select("query_id", "rank", "item", "score")
    found = _in_place(q, v, k, dim, kinds) if n * dim * 8 <= sent_bytes else _by_blocks(q, v, k, dim, kinds, n)
    best = found.groupBy("query_id", "item").agg(F.max("score").alias("score"))
    return top_n(best, ["query_id"], [F.col("score").desc(), F.col("item")], k).select("query_id", "rank", "item", "score")


def _unit(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    return x / np.sqrt((x**2).sum(1, keepdims=True))


def _best(x: np.ndarray, y: np.ndarray, items: pa.Array, k: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """(query row, item, score) of the ``k`` best different items of each query, with all ties of the last place."""
    order = pc.sort_indices(items)
    items, y = items.take(order), y[order.to_numpy()]
    s = np.round(x @ y.T, 9)
    starts = np.flatnonzero(np.r_[True, pc.not_equal(items[1:], items[:-1]).to_numpy(zero_copy_only=False)])
    if len(starts) < len(items):  # an item's best vector stands for it
        s, items = np.maximum.reduceat(s, starts, axis=1), items.take(pa.array(starts))
    keep = min(k, s.shape[1])
    least = np.partition(s, s.shape[1] - keep, axis=1)[:, -keep]
    rows, cols = np.nonzero(s >= least[:, None])
    return rows, items.take(pa.array(cols)), s[rows, cols]


def _in_place(q: DataFrame, v: DataFrame, k: int, dim: int, kinds: str) -> DataFrame:
    sent = q.toArrow()  # its size was checked
    shared = q.sparkSession.sparkContext.broadcast((sent.column("query_id").combine_chunks(), _unit(sent.column("qv"), dim)))

    def run(batches):
        ids, x = shared.value
        held: pa.Table | None = None

        def cut(t: pa.Table) -> pa.Table:
            """The ``k`` best items of each query and the ties of the last."""
            t = t.group_by(["q", "item"]).aggregate([("score", "max")]).rename_columns(["q", "item", "score"])
            row, score = t.column("q").to_numpy(), t.column("score").to_numpy()
            order = np.lexsort((-score, row))
            row, score = row[order], score[order]
            at = np.searchsorted(row, np.arange(len(ids)))
            last = score[np.minimum(at + k - 1, np.searchsorted(row, np.arange(len(ids)), "right") - 1)] if len(row) else score
            return t.take(pa.array(order[score >= last[row]])) if len(row) else t

        for batch in batches:
            for at in range(0, batch.num_rows, VECTOR_BLOCK):
                part = batch.slice(at, VECTOR_BLOCK)
                y = _unit(part.column(1), dim)
                for begin in range(0, len(x), QUERY_BLOCK):
                    rows, items, scores = _best(x[begin : begin + QUERY_BLOCK], y, part.column(0), k)
                    new = pa.table({"q": pa.array(rows + begin), "item": items, "score": scores})
                    held = new if held is None else pa.concat_tables([held, new])
                if held.num_rows > 4 * k * len(ids) + 100_000:
                    held = cut(held)
        if held is not None and held.num_rows:
            held = cut(held)
            yield from pa.table({"query_id": ids.take(held.column("q").combine_chunks()), "item": held.column("item"), "score": held.column("score")}).to_batches()

    return v.mapInArrow(run, kinds)


def _by_blocks(q: DataFrame, v: DataFrame, k: int, dim: int, kinds: str, n: int) -> DataFrame:
    v = materialize(v.distinct(), "vectors")
    nq, nv = -(-n // QUERY_BLOCK), max(1, -(-v.count() // VECTOR_BLOCK))
    blocks = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(nq)).cast("int")).withColumn("vb", blocks(nv))
    right = v.withColumn("ivb", F.pmod(F.xxhash64("item", "v"), F.lit(nv)).cast("int")).withColumn("iqb", blocks(nq))

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": a.column("query_id")[:0], "item": b.column("item")[:0], "score": pa.array([], pa.float64())})
        rows, items, scores = _best(_unit(a.column("qv"), dim), _unit(b.column("v"), dim), b.column("item").combine_chunks(), k)
        return pa.table({"query_id": a.column("query_id").take(pa.array(rows)), "item": items, "score": pa.array(scores)})

    return left.groupBy("qb", "vb").cogroup(right.groupBy("iqb", "ivb")).applyInArrow(meet, kinds)


def retrieve(queries: DataFrame, index: DataFrame, pages: DataFrame, k: int, dim: int, exclude_stubs: bool = True, collapse_aliases: bool = True, pool: int = POOL) -> DataFrame:
    """query_id, rank, chunk_id, page, score: a pool of max(pool, k) vectors, without stubs and later hits of a page, cut to ``k``.

    queries: query_id, vec; index: chunk_id, vec; pages as of ``fusion.page_map``. Chunks that the map doesn't know share the page ''.
    """
    found = search(queries, index, max(pool, k), dim).withColumnRenamed("item", "chunk_id")
    return fusion.collapse(found, pages, k, exclude_stubs, collapse_aliases).select("query_id", "rank", "chunk_id", "page", "score")
