"""The queries of this subpackage, named by problem, and the SQL of those that DuckDB can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import table
from . import bpe, knn, markup, neardup, packing, rankfusion, splitting, subjects, wrappers

#: Problem 1 as stated for chunks: three words, a similarity of 0.7, at least 20 words.
CHUNK_COPIES = {"shingle": 3, "threshold": 0.7, "min_words": 20, "word": neardup.CHUNK_WORD}


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks with nearly the same text."""
    return neardup.similar_pairs(neardup.find(table(spark, folder, "chunks"), **CHUNK_COPIES))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Each chunk's class of equal texts and group of nearly equal texts."""
    return neardup.groups(neardup.find(table(spark, folder, "chunks"), **CHUNK_COPIES)).withColumnRenamed("item", "chunk_id")


def p1_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The same for documents under the general rule, five words and 0.8."""
    return neardup.groups(neardup.find(table(spark, folder, "documents"), item="doc_id")).withColumnRenamed("item", "doc_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks of which one is among the other's five most similar."""
    return knn.neighbour_pairs(knn.nearest(table(spark, folder, "dense_index")))


def p2_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar chunks of every chunk with a usable vector."""
    return knn.nearest(table(spark, folder, "dense_index")).withColumnRenamed("item", "chunk_id")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks whose text holds markup."""
    return markup.clean(table(spark, folder, "chunks"), ["chunk_id"]).select("chunk_id").where("chunk_id IS NOT NULL").distinct()


def p3_clean(spark: SparkSession, folder: str) -> DataFrame:
    """Clean text of the chunks that hold markup."""
    return markup.clean(table(spark, folder, "chunks"), ["chunk_id"])


def p3_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Clean text of the blocks other than code that hold markup."""
    return markup.clean(markup.prose_blocks(table(spark, folder, "blocks")), ["chunk_id", "block_ord"])


def p3_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    """The wrappers inferred for each host and, as host ``*``, for all."""
    return markup.infer(markup.marked(table(spark, folder, "chunks"), ["chunk_id"])).where(F.col("fold") == wrappers.ALL_FOLDS).select("host", "name", "expression", "n")


def _lists(spark: SparkSession, folder: str) -> DataFrame:
    return rankfusion.counted_lists(*(table(spark, folder, t) for t in ("rankings", "chunks", "systems")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """The three chunks of each query with the lowest mean place."""
    return rankfusion.lowest_mean_place(_lists(spark, folder)).select("query_id", "chunk_id")


def p4_fused(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best chunks of each query by reciprocal rank fusion at the usual constant."""
    ranked = rankfusion.fused_ranking(rankfusion.fuse(_lists(spark, folder)), 10)
    return ranked.select("query_id", "chunk_id", F.round("score", 12).alias("score"), F.round("mean_place", 9).alias("mean_place"), F.col("rank").cast("int").alias("rank"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks that had to be cut into pieces."""
    return splitting.split(table(spark, folder, "chunks")).where("n_pieces > 1 AND chunk_id IS NOT NULL").select("chunk_id").distinct()


def p6_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of oversized chunks."""
    return splitting.split(table(spark, folder, "chunks"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(table(spark, folder, "documents"))


def p7_lengths(spark: SparkSession, folder: str) -> DataFrame:
    """Number of tokens of every document."""
    return bpe.count_tokens(table(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in containers of at most 2,048 tokens."""
    return packing.pack(table(spark, folder, "documents"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(p8_containers(spark, folder))


def _subject_tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, t) for t in ("documents", "doc_labels", "subjects")]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects of every document."""
    return subjects.subjects_of(*_subject_tables(spark, folder))


def p9_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and characters of each subject; a document with several subjects counts in each."""
    documents, labels, areas = _subject_tables(spark, folder)
    sized = documents.select("doc_id", F.length("text").alias("n"))
    return subjects.subjects_of(documents, labels, areas).join(sized, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("n").alias("n_chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_groups, p1_documents, p2_found, p2_neighbours, p3_found, p3_clean, p3_blocks, p3_wrappers, p4_found, p4_fused,
            p6_found, p6_pieces, p7_ids, p7_lengths, p8_containers, p8_fill, p9_found, p9_composition,
        )
    }


_PLACES = """
WITH best AS (
  SELECT r.query_id, r.system, r.chunk_id, CASE WHEN coalesce(s.higher_is_better, true) THEN -max(r.score) ELSE min(r.score) END AS k
  FROM rankings r JOIN systems s ON r.system = s.system
  WHERE r.score IS NOT NULL AND NOT isnan(r.score) AND r.query_id IS NOT NULL AND r.chunk_id IN (SELECT chunk_id FROM chunks)
  GROUP BY r.query_id, r.system, r.chunk_id, s.higher_is_better),
placed AS (SELECT *, rank() OVER (PARTITION BY query_id, system ORDER BY k) AS place FROM best),
lists AS (SELECT query_id, system, count(*) AS n FROM best GROUP BY query_id, system),
everywhere AS (SELECT DISTINCT query_id, chunk_id FROM best),
places AS (
  SELECT e.query_id, e.chunk_id, coalesce(p.place, l.n + 1) AS place
  FROM everywhere e JOIN lists l USING (query_id) LEFT JOIN placed p ON p.query_id = e.query_id AND p.system = l.system AND p.chunk_id = e.chunk_id),
fused AS (SELECT query_id, chunk_id, sum(1e0 / (60 + place)) AS score, avg(place) AS mean_place FROM places GROUP BY query_id, chunk_id)
"""


_NEAR_COPIES = """
WITH w AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS w FROM chunks WHERE chunk_id IS NOT NULL AND text IS NOT NULL),
s AS (SELECT row_number() OVER () AS i, chunk_id, list_distinct(list_transform(range(1, len(w) - 1), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2])) AS s FROM w WHERE len(w) >= 20),
u AS (SELECT i, chunk_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.chunk_id AS x, b.chunk_id AS y, a.i, b.i AS j, a.n AS na, b.n AS nb, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.i < b.i GROUP BY ALL)
SELECT DISTINCT least(x, y) AS chunk_id_a, greatest(x, y) AS chunk_id_b FROM p WHERE x <> y AND c >= 0.7 * (na + nb - c) - 1e-9"""
_NEAREST = """
WITH v AS (SELECT DISTINCT chunk_id, vec::DOUBLE[] AS v FROM dense_index WHERE chunk_id IS NOT NULL AND len(vec) = 64 AND len(list_filter(vec, lambda x: x <> 0)) > 0),
n AS (SELECT chunk_id, v, sqrt(list_dot_product(v, v)) AS l FROM v),
s AS (SELECT a.chunk_id AS x, b.chunk_id AS y, max(round(list_dot_product(a.v, b.v) / (a.l * b.l), 9)) AS c FROM n a JOIN n b ON a.chunk_id <> b.chunk_id GROUP BY ALL),
r AS (SELECT x, y, c, row_number() OVER (PARTITION BY x ORDER BY c DESC, y)::INT AS rank FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY c DESC, y) <= 5)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _NEAR_COPIES,
        "p2_found": _NEAREST + "SELECT DISTINCT least(x, y) AS chunk_id_a, greatest(x, y) AS chunk_id_b FROM r",
        "p2_neighbours": _NEAREST + "SELECT x AS chunk_id, y AS neighbour, rank, c AS cosine FROM r",
        "p4_found": _PLACES + "SELECT query_id, chunk_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mean_place, score DESC, chunk_id) AS r FROM fused) WHERE r <= 3",
        "p4_fused": _PLACES
        + "SELECT query_id, chunk_id, round(score, 12) AS score, round(mean_place, 9) AS mean_place, r::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 15) DESC, chunk_id) AS r FROM fused) WHERE r <= 10",
        "p6_found": r"SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL AND len(list_filter(string_split_regex(text, '[ \t\n\r]+'), lambda w: w <> '')) > 512",
    }
