"""Searches by name over one corpus, run once each, and their evaluation.

A search is a function of a table of queries (query_id, query) and a depth to query_id, rank, chunk_id, score. It
plans; nothing runs before its result is read.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import materialize
from . import agent, bm25, dense, fusion, metrics, rerank

Search = Callable[[DataFrame, int], DataFrame]
#: Searches that stubs and aliases can be switched off for; all others fuse pages, or read a base that has its defaults.
SWITCHABLE = ("bm25", "dense")


@dataclass
class Corpus:
    """What searches read: chunks, the map of chunks to pages, a lexical index and, if there is one, vectors (chunk_id, vec)."""

    chunks: DataFrame
    pages: DataFrame
    index: bm25.Index
    vectors: DataFrame | None = None
    dim: int = 64
    encoder: dense.Encoder | None = None
    stem: bool = True


def switches(names: list[str], keep_aliases: bool = False, keep_stubs: bool = False) -> dict[str, bool]:
    """Arguments of the switched-off quality rules; ValueError if a search among ``names`` has no such switch."""
    asked = {n: False for n, kept in (("collapse_aliases", keep_aliases), ("exclude_stubs", keep_stubs)) if kept}
    fixed = sorted(set(names) - set(SWITCHABLE))
    if asked and fixed:
        raise ValueError(f"{', '.join(asked)} can't be switched off for {', '.join(fixed)}, only for {', '.join(SWITCHABLE)}")
    return asked


def lexical(corpus: Corpus, **quality: bool) -> Search:
    def search(queries: DataFrame, k: int) -> DataFrame:
        found = bm25.search(corpus.index, queries, max(bm25.POOL, k), stem=corpus.stem).withColumnRenamed("doc", "chunk_id")
        return fusion.collapse(found, corpus.pages, k, **quality).select("query_id", "rank", "chunk_id", "score")

    return search


def by_vectors(corpus: Corpus, **quality: bool) -> Search:
    """Queries with a vector of their own (column vec) are searched by it, others are encoded."""
    if corpus.vectors is None:
        raise ValueError("this corpus has no vectors")

    def search(queries: DataFrame, k: int) -> DataFrame:
        asked = queries
        if "vec" not in queries.columns:
            texts = queries.select("query_id", F.lit("").alias("title"), F.array().cast("array<string>").alias("heading_path"), F.col("query").alias("text"))
            asked = dense.encode(texts, corpus.encoder, item="query_id", is_query=True)
        return dense.retrieve(asked, corpus.vectors, corpus.pages, k, corpus.dim, **quality).select("query_id", "rank", "chunk_id", "score")

    return search


def hybrid(corpus: Corpus, depth: int = fusion.DEPTH) -> Search:
    """The lexical and the vector search to ``depth``, fused by page."""
    parts = {"bm25": lexical(corpus), "dense": by_vectors(corpus)}

    def search(queries: DataFrame, k: int) -> DataFrame:
        fused = fusion.fuse(run_all(parts, queries, depth, written=False), corpus.pages, {n: i for i, n in enumerate(parts)}, k, depth=depth)
        return fused.select("query_id", "rank", "chunk_id", "score")

    return search


def reranked(corpus: Corpus, base: Search, scorer: rerank.Scorer | None = None, top: int = rerank.TOP_N) -> Search:
    return lambda queries, k: rerank.rerank(base(queries, max(top, k)), queries, corpus.chunks, k, scorer, top)


def routed(corpus: Corpus, base: Search, verdicts: DataFrame, parts: DataFrame) -> Search:
    """Queries as the model's answers (query_id, text) route them: decomposed ones in parts, fused by page."""

    def search(queries: DataFrame, k: int) -> DataFrame:
        subs = agent.sub_queries(agent.route(queries.select("query_id", "query"), verdicts), parts)
        return agent.agent_search(subs, base, corpus.pages, k).select("query_id", "rank", "chunk_id", "score")

    return search


def registry(corpus: Corpus, keep_aliases: bool = False, keep_stubs: bool = False, scorer: rerank.Scorer | None = None, verdicts: DataFrame | None = None, parts: DataFrame | None = None) -> dict[str, Search]:
    """The searches that this corpus allows, by name."""
    quality = switches([], keep_aliases, keep_stubs)
    found: dict[str, Search] = {"bm25": lexical(corpus, **quality), "rerank(bm25)": reranked(corpus, lexical(corpus), scorer)}
    base = lexical(corpus)
    if corpus.vectors is not None:
        base = hybrid(corpus)
        found |= {"dense": by_vectors(corpus, **quality), "hybrid": base, "rerank(hybrid)": reranked(corpus, base, scorer)}
    if verdicts is not None and parts is not None:
        found["agent"] = routed(corpus, base, verdicts, parts)
    return found


def run_all(searches: Mapping[str, Search], queries: DataFrame, k: int, written: bool = True) -> DataFrame:
    """system, query_id, rank, chunk_id, score of every search, each run once and written, so that all that follows reads the same lists."""
    runs = [search(queries, k).select(F.lit(name).alias("system"), "query_id", "rank", "chunk_id", F.col("score").cast("double").alias("score")) for name, search in searches.items()]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return materialize(out, "runs") if written else out


def evaluate(searches: Mapping[str, Search], queries: DataFrame, qrels: DataFrame, located: DataFrame, k: int = 10, include_unjudged: bool = False, canonical: DataFrame | None = None) -> DataFrame:
    """Scores of every search and query, as ``metrics.per_query`` gives them, over lists of max(k, 10) chunks.

    queries: query_id, query, category; located: chunk_id, page, anchor. With ``canonical`` (url, page) judgments move to their canonical
    page, where the last one counts.
    """
    judged = metrics.judged_units(qrels, canonical)
    runs = metrics.run_units(run_all(searches, queries, max(k, metrics.NDCG_K)), located, judged)
    return metrics.per_query(runs, judged, queries, include_unjudged, sorted(searches))
