"""The queries of the core, by name; their SQL is in ``oracle``. All read whole tables.

The test tables hold rankings but no judgments and no query texts. Judgments are taken from the table
``fused``: a chunk's page has grade 2 for a best rank up to 3, else 1. Page titles serve as query texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import analysis, jsonx
from ..functions import text as X
from ..operators import agent, bm25, chunking, dense, fusion, generation, metrics, pooling, prompts, quality, reliability, report, resample, rerank, retrievers, snapshots, upsert
from ..sources import web
from .oracle import oracle_sql
from .ranking import top_n
from .shared import table

__all__ = ["oracle_sql", "queries"]

SYSTEMS = ("bm25", "dense", "rerank", "agent", "distance")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


# ---- shared inputs


def _titles(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "pages").where("title IS NOT NULL").select(F.col("title").alias("query_id"), F.col("title").alias("query")).distinct()


def _chunks(s: SparkSession, d: str) -> DataFrame:
    """Chunks with repeats of a row counted once."""
    return table(s, d, "chunks").dropDuplicates(["chunk_id", "url", "ordinal", "text"])


def _page_map(s: SparkSession, d: str) -> DataFrame:
    return fusion.page_map(table(s, d, "chunks"), table(s, d, "pages"))


def _runs(s: SparkSession, d: str) -> DataFrame:
    """system, query_id, rank, chunk_id: the scored chunks of each list, best first."""
    rows = table(s, d, "rankings").where("score IS NOT NULL AND chunk_id IS NOT NULL").join(table(s, d, "systems").select("system", "higher_is_better"), "system")
    best = rows.groupBy("system", "query_id", "chunk_id").agg(F.min(F.when(F.col("higher_is_better"), -F.col("score")).otherwise(F.col("score"))).alias("key"))
    order = W.partitionBy("system", "query_id").orderBy("key", "chunk_id")
    return best.select("system", "query_id", F.row_number().over(order).alias("rank"), "chunk_id")


def _one_run(s: SparkSession, d: str, system: str = "bm25") -> DataFrame:
    return _runs(s, d).where(F.col("system") == system).drop("system")


def _qrels(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "fused").join(_page_map(s, d), "chunk_id")
    return rows.groupBy("query_id", F.col("page").alias("unit")).agg(F.max(F.when(F.col("best_rank") <= 3, 2).otherwise(1)).alias("grade"))


def _asked(s: SparkSession, d: str) -> DataFrame:
    """query_id, category: the queries of the rankings in four categories by their number."""
    number = F.regexp_extract("query_id", r"(\d+)$", 1).cast("int")
    names = F.array(*[F.lit(c) for c in ("api_lookup", "conceptual", "multi_hop", "tutorial")])
    return table(s, d, "rankings").where("query_id IS NOT NULL").select("query_id").distinct().withColumn("category", F.element_at(names, number % 4 + 1))


def _page_runs(s: SparkSession, d: str) -> DataFrame:
    located = _page_map(s, d).withColumn("anchor", F.lit(""))
    return metrics.run_units(_runs(s, d), located, _qrels(s, d))


def _scores(s: SparkSession, d: str) -> DataFrame:
    return metrics.per_query(_page_runs(s, d), _qrels(s, d), _asked(s, d))


def _url_map(s: SparkSession, d: str) -> DataFrame:
    return _page_map(s, d).select("url", "page").distinct()


def _pool(s: SparkSession, d: str) -> DataFrame:
    return pooling.build_pool(_runs(s, d), _page_map(s, d), table(s, d, "chunks"), SYSTEMS, 10)


# ---- search


@_query
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    """Ten best chunks for every page title, over title, headings and text, without stems."""
    return bm25.search(bm25.build_index(table(s, d, "chunks"), stem=False), _titles(s, d), 10, stem=False)


@_query
def bm25_stemmed(s: SparkSession, d: str) -> DataFrame:
    """The same with folded and stemmed terms, then stubs and aliases collapsed: the full lexical search."""
    return bm25.search_pages(bm25.build_index(table(s, d, "chunks")), _titles(s, d), _page_map(s, d), 10)


@_query
def match_terms(s: SparkSession, d: str) -> DataFrame:
    """Match expression of every page title."""
    return _titles(s, d).select("query", X.match_expression("query").alias("expression"))


@_query
def dense_topk(s: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors of every vector whose id is divisible by 100, against all."""
    v = table(s, d, "embeddings")
    asked = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return dense.search(asked, v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec")), 10, 64).select("query_id", "rank", F.col("item").alias("vec_id"), "score")


@_query
def hash_embed_topk(s: SparkSession, d: str) -> DataFrame:
    """Ten nearest documents by hashed words of every document whose id is divisible by 100, against all."""
    docs = table(s, d, "documents").select("doc_id", F.lit("").alias("title"), F.array().cast("array<string>").alias("heading_path"), "text")
    index = dense.encode(docs, item="doc_id").select(F.col("doc_id").alias("chunk_id"), "vec")
    asked = index.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    return dense.search(asked, index, 10, 64).select("query_id", "rank", F.col("item").alias("doc_id"), F.round("score", 6).alias("score"))


def _probes(s: SparkSession, d: str) -> DataFrame:
    """query_id, query, vec: every indexed chunk whose id is divisible by 100, with its title as text and one of its vectors."""
    usable = table(s, d, "dense_index").where("size(vec) = 64 AND exists(vec, x -> x <> 0)")
    vectors = usable.groupBy("chunk_id").agg(F.min("vec").alias("vec")).where(F.conv(F.substring("chunk_id", 13, 4), 16, 10).cast("long") % 100 == 0)
    titles = table(s, d, "chunks").where("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max("title").alias("title"))
    return vectors.join(titles, "chunk_id").select(F.col("chunk_id").alias("query_id"), F.coalesce("title", F.lit("")).alias("query"), "vec")


def _corpus(s: SparkSession, d: str) -> retrievers.Corpus:
    chunks = table(s, d, "chunks")
    return retrievers.Corpus(chunks, _page_map(s, d), bm25.build_index(chunks, stem=False), table(s, d, "dense_index").select("chunk_id", "vec"), stem=False)


@_query
def dense_search(s: SparkSession, d: str) -> DataFrame:
    """The whole vector search: a pool of 500, without stubs and later hits of a page, cut to ten."""
    return dense.retrieve(_probes(s, d), table(s, d, "dense_index"), _page_map(s, d), 10, 64)


@_query
def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    """Title and vector of each probe searched, both lists fused by page."""
    found = retrievers.registry(_corpus(s, d))["hybrid"](_probes(s, d), 10)
    return found.withColumn("score", F.round("score", 12))


@_query
def live_metrics(s: SparkSession, d: str) -> DataFrame:
    """The lexical search run for every page title and scored: the pages of that title are relevant."""
    pages = table(s, d, "pages").where("title IS NOT NULL AND url IS NOT NULL").select(F.col("title").alias("query_id"), "url").distinct()
    known = table(s, d, "pages").where("url IS NOT NULL").groupBy("url").agg(F.max(F.when(F.col("canonical_url") != "", F.col("canonical_url"))).alias("c"))
    qrels = pages.join(known, "url", "left").select("query_id", F.coalesce("c", "url").alias("unit"), F.lit(2).alias("grade")).distinct()
    asked = _titles(s, d).withColumn("category", F.lit("title"))
    corpus = _corpus(s, d)
    scores = retrievers.evaluate({"bm25": retrievers.lexical(corpus)}, asked, qrels, corpus.pages.withColumn("anchor", F.lit("")))
    return scores.select("system", "query_id", "judged", "n_relevant", *[F.round(c, 9).alias(c) for c in ("recall_5", "recall_10", "mrr", "ndcg_10")])


@_query
def dense_stats(s: SparkSession, d: str) -> DataFrame:
    return dense.index_stats(table(s, d, "dense_index").where("size(vec) = 64"), 64)


@_query
def corpus_fingerprint(s: SparkSession, d: str) -> DataFrame:
    return dense.fingerprint(table(s, d, "chunks"))


@_query
def rerank_overlap(s: SparkSession, d: str) -> DataFrame:
    """All chunks of each title reranked by the words they share with it; ties by chunk_id.

    A title's chunks have no ranking of their own, so all stand at the first place and all are scored.
    """
    base = _chunks(s, d).where("title IS NOT NULL").select(F.col("title").alias("query_id"), F.lit(1).alias("rank"), "chunk_id").distinct()
    return rerank.rerank(base, base.select("query_id", F.col("query_id").alias("query")).distinct(), table(s, d, "chunks"), 10)


@_query
def random_baseline(s: SparkSession, d: str) -> DataFrame:
    return rerank.random_run(_asked(s, d), table(s, d, "chunks"), 10, seed=0)


# ---- fusion


@_query
def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    """Pages fused over all systems, with the chunk that shows each."""
    return fusion.fuse(_runs(s, d), _page_map(s, d), {n: i for i, n in enumerate(SYSTEMS)}, 10).drop("ranks")


@_query
def rrf_explain(s: SparkSession, d: str) -> DataFrame:
    """The place of each fused page in each system."""
    fused = fusion.fuse(_runs(s, d), _page_map(s, d), {n: i for i, n in enumerate(SYSTEMS)}, 10)
    return fused.select("query_id", "page", F.explode("ranks").alias("system", "system_rank"))


@_query
def rrf_items(s: SparkSession, d: str) -> DataFrame:
    return fusion.item_scores(_runs(s, d).withColumnRenamed("chunk_id", "item")).withColumn("score", F.round("score", 12))


@_query
def rrf_compact(s: SparkSession, d: str) -> DataFrame:
    """The fusion of sub-queries: scored by the place among pages."""
    return fusion.fuse(_runs(s, d), _page_map(s, d), {n: i for i, n in enumerate(SYSTEMS)}, 10, depth=10, compact=True).drop("ranks")


@_query
def alias_collapse(s: SparkSession, d: str) -> DataFrame:
    """The BM25 lists without stubs and later hits of a page."""
    return fusion.collapse(_one_run(s, d), _page_map(s, d), 10).select("query_id", "rank", "chunk_id", "page")


@_query
def policy_grid(s: SparkSession, d: str) -> DataFrame:
    """Slots of the four policies of stubs and aliases."""
    grid = fusion.policies(_one_run(s, d), _page_map(s, d), 10)
    return grid.groupBy("exclude_stubs", "collapse_aliases").agg(F.count(F.lit(1)).alias("n_slots"), F.count_distinct("page").alias("n_pages"))


@_query
def duplicate_slots(s: SparkSession, d: str) -> DataFrame:
    return fusion.duplicate_slots(_runs(s, d).where("rank <= 10"), _page_map(s, d))


@_query
def changed_lists(s: SparkSession, d: str) -> DataFrame:
    """Queries whose ten best change when aliases collapse."""
    run, pages = _one_run(s, d), _page_map(s, d)
    return fusion.changed_lists(fusion.collapse(run, pages, 10, True, False), fusion.collapse(run, pages, 10)).groupBy("changed").agg(F.count(F.lit(1)).alias("n"))


# ---- corpus


@_query
def p5_found(s: SparkSession, d: str) -> DataFrame:
    """Chunks added, removed or changed from one snapshot to the next."""
    return snapshots.snapshot_changes(table(s, d, "chunk_snapshots"))


@_query
def page_signatures(s: SparkSession, d: str) -> DataFrame:
    return quality.page_texts(table(s, d, "chunks")).select("url", "n_chunks", "n_tokens", "signature")


@_query
def alias_groups(s: SparkSession, d: str) -> DataFrame:
    return quality.alias_groups(quality.alias_clusters(quality.page_texts(table(s, d, "chunks"))))


@_query
def text_only_collisions(s: SparkSession, d: str) -> DataFrame:
    return quality.text_only_collisions(quality.alias_clusters(quality.page_texts(table(s, d, "chunks"))))


def _moved(s: SparkSession, d: str) -> DataFrame:
    """All chunks; the texts of those with an even id say that they were moved, which none of the test tables' does."""
    says = F.concat(F.coalesce("text", F.lit("")), F.lit(" It has been moved."))
    return table(s, d, "chunks").withColumn("text", F.when(F.right("chunk_id", F.lit(1)).isin(*"02468ace"), says).otherwise(F.col("text")))


@_query
def quality_analysis(s: SparkSession, d: str) -> DataFrame:
    return quality.analyze(_moved(s, d))


@_query
def quality_report(s: SparkSession, d: str) -> DataFrame:
    return quality.report(quality.analyze(_moved(s, d)))


@_query
def quality_applied(s: SparkSession, d: str) -> DataFrame:
    return quality.quality_counts(quality.apply_quality(table(s, d, "pages"), quality.analyze(_moved(s, d))))


@_query
def quality_counts(s: SparkSession, d: str) -> DataFrame:
    return quality.quality_counts(table(s, d, "pages"))


@_query
def canonical_map(s: SparkSession, d: str) -> DataFrame:
    return quality.canonical_map(table(s, d, "pages"))


@_query
def stub_urls(s: SparkSession, d: str) -> DataFrame:
    return quality.stub_urls(table(s, d, "pages"))


@_query
def stub_pages(s: SparkSession, d: str) -> DataFrame:
    """Pages that are placeholders by their text."""
    p = quality.page_texts(_moved(s, d))
    return p.where(X.is_stub(F.col("n_chunks"), F.col("n_tokens"), F.col("says_stub"))).select("url")


@_query
def reported_aliases(s: SparkSession, d: str) -> DataFrame:
    """The groups of the stored report, one row a page, whether the two paths are compatible."""
    groups = table(s, d, "quality_report").select("report_id", F.explode("alias_groups").alias("g")).distinct()
    canonical = F.array_min(F.transform("g", lambda u: F.named_struct(F.lit("n"), F.length(u), F.lit("u"), u)))["u"]
    rows = groups.select("report_id", canonical.alias("canonical_url"), F.explode("g").alias("url"))
    return rows.withColumn("compatible", X.alias_compatible("canonical_url", "url"))


def _loaded(s: SparkSession, d: str) -> upsert.Loaded:
    """The corpus after all tutorial pages were delivered again, texts trimmed, without the chunks of each page's last ordinal."""
    pages, chunks = table(s, d, "pages"), _chunks(s, d)
    tutorials = chunks.where(F.instr("url", "/tutorials/") > 0)
    last = tutorials.groupBy("url").agg(F.max("ordinal").alias("_last"))
    batch = tutorials.join(last, "url").where("ordinal < _last").drop("_last").withColumn("text", F.trim("text"))
    stored = chunks.groupBy("chunk_id").agg(F.max(F.struct(*[c for c in chunks.columns if c != "chunk_id"])).alias("v")).select("chunk_id", "v.*")
    return upsert.load(pages, stored, batch)


@_query
def upsert_load(s: SparkSession, d: str) -> DataFrame:
    """What a load did."""
    return _loaded(s, d).counts


@_query
def upsert_chunks(s: SparkSession, d: str) -> DataFrame:
    """The chunks after the load."""
    return _loaded(s, d).chunks.select("chunk_id", "url", F.md5("text").alias("text_md5"))


@_query
def upsert_pages(s: SparkSession, d: str) -> DataFrame:
    """The pages after the load."""
    return _loaded(s, d).pages.select("url", "title", "n_chunks", "canonical_url", "status")


@_query
def corpus_counts(s: SparkSession, d: str) -> DataFrame:
    return upsert.counts(table(s, d, "pages"), table(s, d, "chunks"))


@_query
def located_chunks(s: SparkSession, d: str) -> DataFrame:
    return upsert.locate(table(s, d, "rankings"), table(s, d, "chunks"))


@_query
def chunk_fields(s: SparkSession, d: str) -> DataFrame:
    """Derived fields of every chunk: snippet, section, unit, source, hash, words, short text."""
    c = _chunks(s, d)
    return c.select(
        "chunk_id", "ordinal", X.snippet("text").alias("snippet"), X.section_label("heading_path").alias("section"), X.unit_key("url", "anchor").alias("unit"), X.source_of_url("url").alias("source"),
        X.content_hash("text").alias("hash"), X.word_count("text").alias("n_words"), F.md5(X.short_identifiers("text")).alias("short_md5"), F.md5(X.embedding_text("title", "heading_path", "text")).alias("embed_md5"),
    )


@_query
def chunk_ids(s: SparkSession, d: str) -> DataFrame:
    """Positional ids: each chunk numbered within its section."""
    c = _chunks(s, d).where("heading_path IS NOT NULL")
    return upsert.section_index(c).select("chunk_id", "url", "ordinal", X.chunk_id("url", "heading_path", F.col("section_no")).alias("positional_id"))


@_query
def url_fields(s: SparkSession, d: str) -> DataFrame:
    """Path segments, devices and mirror path of every page."""
    p = table(s, d, "pages").select("url").distinct()
    return p.select("url", F.array_join(X.path_segments("url"), "|").alias("segments"), F.array_join(X.device_set(X.path_segments("url")), "|").alias("devices"), web.mirror_path("url").alias("mirror"))


@_query
def sitemap_urls(s: SparkSession, d: str) -> DataFrame:
    """URLs out of sitemaps, one a page, moved from stable to a version, without the notes."""
    maps = table(s, d, "pages").select(F.concat(F.lit("<urlset><url><loc> "), "url", F.lit(" </loc></url></urlset>")).alias("xml"))
    return web.url_list(web.sitemap_urls(maps), "stable", "3.2", "/notes/")


@_query
def length_stats(s: SparkSession, d: str) -> DataFrame:
    return chunking.size_stats(table(s, d, "chunks"))


@_query
def length_histogram(s: SparkSession, d: str) -> DataFrame:
    return chunking.size_histogram(table(s, d, "chunks"))


@_query
def source_breakdown(s: SparkSession, d: str) -> DataFrame:
    return chunking.source_breakdown(table(s, d, "pages"), table(s, d, "chunks"))


@_query
def short_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.short_chunks(table(s, d, "chunks"))


def _block_pages(s: SparkSession, d: str) -> DataFrame:
    """One page of HTML a url from all its blocks: headings, paragraphs, lists, tables and code."""
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    wrap = lambda tag, c: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    all_of = lambda c, f: F.array_join(F.transform(c, f), "")
    text, lines = F.coalesce("text", F.lit("")), F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(x) != "")
    cells = lambda line: F.split(F.regexp_replace(line, r"^ *\| ?| ?\| *$", ""), r"\|")
    kind = F.lower(F.trim(F.coalesce("kind", F.lit(""))))
    body = (
        F.when(kind == "code", F.concat(F.lit('<div class="highlight-'), F.coalesce("lang", F.lit("default")), F.lit('"><pre>'), esc(text), F.lit("</pre></div>")))
        .when(kind == "list", wrap("ul", all_of(lines, lambda x: wrap("li", esc(F.regexp_replace(x, r"^ *(- |\d+\. )", ""))))))
        .when(kind == "table", wrap("table", all_of(lines, lambda x: wrap("tr", all_of(cells(x), lambda c: wrap("td", esc(c)))))))
        .otherwise(wrap("p", esc(text)))
    )
    path = F.when(F.size("heading_path") > 0, F.col("heading_path")).otherwise(F.array(F.lit("Untitled")))
    heads = F.array_join(F.transform(path, lambda h, i: F.concat(F.lit("<h"), (i + 1).cast("string"), F.lit(">"), esc(h), F.lit("</h"), (i + 1).cast("string"), F.lit(">"))), "")
    rows = table(s, d, "blocks").groupBy("url", "chunk_id", "block_ord").agg(F.min(F.struct("kind", "text", "heading_path", "lang")).alias("b")).select("url", "chunk_id", "block_ord", "b.*")
    first = rows.groupBy("url", "chunk_id").agg(F.min("block_ord").alias("_first"))
    rows = rows.join(first, ["url", "chunk_id"]).select("url", "chunk_id", "block_ord", F.concat(F.when(F.col("block_ord") == F.col("_first"), heads).otherwise(F.lit("")), body).alias("html"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "block_ord", "html"))), lambda x: x["html"]), "")
    return rows.groupBy("url").agg(F.concat(F.lit("<html><body><nav>menu</nav><article>"), whole, F.lit("</article></body></html>")).alias("html"))


@_query
def html_chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_pages(_block_pages(s, d))


@_query
def html_blocks(s: SparkSession, d: str) -> DataFrame:
    found = chunking.page_blocks(_block_pages(s, d))
    return found.select("url", "title", "block_ord", "kind", "text", F.array_join("heading_path", " > ").alias("path"), "lang")


@_query
def analyzed_terms(s: SparkSession, d: str) -> DataFrame:
    """Words of documents and how often they stand there, as the plain analyzer sees them."""
    terms = table(s, d, "documents").select(F.explode(analysis.plain_words("text")).alias("term"))
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


# ---- evaluation


@_query
def metrics_per_query(s: SparkSession, d: str) -> DataFrame:
    scores = _scores(s, d)
    return scores.select("system", "query_id", "category", "judged", "n_relevant", *[F.round(c, 9).alias(c) for c in ("recall_5", "recall_10", "mrr", "ndcg_10", "ceiling_5", "ceiling_10")])


@_query
def metrics_summary(s: SparkSession, d: str) -> DataFrame:
    out = metrics.summarize(_scores(s, d))
    return out.select("system", "category", "n", *[F.round(c, 9).alias(c) for c in out.columns[3:]])


@_query
def ceiling(s: SparkSession, d: str) -> DataFrame:
    return metrics.ceiling(_qrels(s, d), _asked(s, d), 5).withColumn("ceiling", F.round("ceiling", 9))


@_query
def win_loss_tie(s: SparkSession, d: str) -> DataFrame:
    return metrics.win_loss_tie(_scores(s, d), "rerank", "bm25", "recall_10")


@_query
def pool_union(s: SparkSession, d: str) -> DataFrame:
    return _pool(s, d)


def _judged(s: SparkSession, d: str) -> DataFrame:
    return pooling.judged_pages(_qrels(s, d), _url_map(s, d))


@_query
def pool_delta(s: SparkSession, d: str) -> DataFrame:
    return pooling.delta_counts(_pool(s, d), _judged(s, d), _asked(s, d))


@_query
def coverage(s: SparkSession, d: str) -> DataFrame:
    return pooling.coverage(_pool(s, d), _judged(s, d), _asked(s, d)).withColumn("rate", F.round("rate", 9))


@_query
def system_coverage(s: SparkSession, d: str) -> DataFrame:
    return pooling.system_coverage(_runs(s, d), _page_map(s, d), _judged(s, d)).withColumn("rate", F.round("rate", 9))


def _new_judgments(s: SparkSession, d: str) -> DataFrame:
    firsts = _page_runs(s, d).where("rank = 1")
    return firsts.select("query_id", "unit", F.lit(2).alias("grade"))


@_query
def append_judgments(s: SparkSession, d: str) -> DataFrame:
    """Judgments after the first page of every list was appended as grade 2."""
    return pooling.append_judgments(_qrels(s, d), _new_judgments(s, d))[0]


@_query
def append_conflicts(s: SparkSession, d: str) -> DataFrame:
    return pooling.append_judgments(_qrels(s, d), _new_judgments(s, d))[1]


@_query
def merge_judgments(s: SparkSession, d: str) -> DataFrame:
    return pooling.merge_judgments(_qrels(s, d), _new_judgments(s, d).distinct(), force=True)


def _ratings(s: SparkSession, d: str) -> DataFrame:
    """Two ratings of each document's size: by the stored and by the true number of characters."""
    grade = lambda n: F.when(n < 300, 0).when(n < 1000, 1).otherwise(2)
    docs = table(s, d, "documents").where("n_chars IS NOT NULL AND text IS NOT NULL")
    return docs.select(grade(F.col("n_chars")).alias("original"), grade(F.length("text")).alias("regrade"))


@_query
def kappa(s: SparkSession, d: str) -> DataFrame:
    k = reliability.kappa(_ratings(s, d))
    return k.select("n", *[F.round(c, 9).alias(c) for c in ("kappa", "observed", "chance")])


@_query
def confusion(s: SparkSession, d: str) -> DataFrame:
    return reliability.confusion(_ratings(s, d))


@_query
def reproduction(s: SparkSession, d: str) -> DataFrame:
    return reliability.reproduction(_ratings(s, d)).withColumn("share", F.round("share", 9))


@_query
def fisher(s: SparkSession, d: str) -> DataFrame:
    """Whether long documents are as frequent in each section as in all others."""
    docs = table(s, d, "documents").where("text IS NOT NULL AND section IS NOT NULL").withColumn("long", F.length("text") >= 1000)
    per = docs.groupBy("section").agg(F.count_if("long").alias("a"), F.count_if(~F.col("long")).alias("b"))
    total = per.agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    out = reliability.fisher_exact(per.crossJoin(F.broadcast(total)).select("section", "a", "b", (F.col("ta") - F.col("a")).alias("c"), (F.col("tb") - F.col("b")).alias("d")))
    return out.withColumn("p_value", F.round("p_value", 6))


def _draws(s: SparkSession, d: str) -> DataFrame:
    transitions = s.createDataFrame([(0, 18, 2, 0), (1, 11, 6, 3), (2, 2, 8, 10)], "original int, g0 long, g1 long, g2 long")
    return resample.paired_draws(_page_runs(s, d), _qrels(s, d), _asked(s, d), transitions)


@_query
def bootstrap_intervals(s: SparkSession, d: str) -> DataFrame:
    return resample.intervals(_draws(s, d), ["system", "category", "metric"])


@_query
def bootstrap_pairs(s: SparkSession, d: str) -> DataFrame:
    return resample.paired_intervals(_draws(s, d), [("rerank", "bm25"), ("dense", "bm25"), ("agent", "rerank")])


@_query
def ratio_bootstrap(s: SparkSession, d: str) -> DataFrame:
    """Interval of the share of relevant slots among the first ten of each system."""
    hits = _page_runs(s, d).where("rank <= 10").join(_qrels(s, d), ["query_id", "unit"], "left")
    rows = hits.groupBy("system", "query_id").agg(F.count("grade").alias("supported"), F.count(F.lit(1)).alias("total"))
    return resample.ratio_intervals(resample.ratio_draws(rows, "system"), "system")


@_query
def latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    out = report.latency_table(table(s, d, "events"), "event_type", "value")
    return out.withColumn("mean_s", F.round("mean_s", 6))


@_query
def latency_stats(s: SparkSession, d: str) -> DataFrame:
    out = rerank.latency_stats(table(s, d, "events"), ["event_type"], "value")
    return out.withColumns({"mean_s": F.round("mean_s", 6), "median_s": F.round("median_s", 6)})


# ---- agent and generation, over answers made from the tables


@_query
def json_members(s: SparkSession, d: str) -> DataFrame:
    """The events' JSON read with type checks."""
    v = jsonx.whole_object("props")
    k = F.try_variant_get(v, "$.k", "long")
    return table(s, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.count(jsonx.string_at(v, "k")).alias("n_strings"))


def _verdicts(s: SparkSession, d: str) -> DataFrame:
    """A routing answer of each query: fenced, in capitals, of a wrong type, or readable, by its number."""
    n = F.regexp_extract("query_id", r"(\d+)$", 1).cast("int") % 5
    text = (
        F.when(n == 0, F.lit('```json\n{"route": "Decompose", "reason": "two parts"}\n```')).when(n == 1, F.lit('{"route": "direct"}')).when(n == 2, F.lit('{"route": 1}'))
        .when(n == 3, F.lit("decompose")).otherwise(F.lit('So: {"route": " DECOMPOSE "}'))
    )
    return _asked(s, d).select("query_id", F.col("query_id").alias("query"), text.alias("text"))


@_query
def agent_routes(s: SparkSession, d: str) -> DataFrame:
    v = _verdicts(s, d)
    return agent.route(v.select("query_id", "query"), v)


@_query
def agent_sub_queries(s: SparkSession, d: str) -> DataFrame:
    v = _verdicts(s, d)
    n = F.regexp_extract("query_id", r"(\d+)$", 1).cast("int") % 2
    parts = F.when(n == 0, F.lit('{"sub_queries": ["a", " a ", 3, "", "b", "c", "d"]}')).otherwise(F.lit('{"sub_queries": "a"}'))
    return agent.sub_queries(agent.route(v.select("query_id", "query"), v), v.select("query_id", parts.alias("text")))


@_query
def agent_pages(s: SparkSession, d: str) -> DataFrame:
    """Two sub-queries a page, its title and its first heading's words, searched in one batch and fused."""
    index = bm25.build_index(table(s, d, "chunks"), stem=False)
    find = lambda q, depth: bm25.search(index, q, depth, stem=False).withColumnRenamed("doc", "chunk_id").select("query_id", "rank", "chunk_id")
    subs = _titles(s, d).select("query_id", F.posexplode(F.array("query", F.concat("query", F.lit(" overview")))).alias("sub_no", "sub_query"))
    return agent.agent_search(subs, find, _page_map(s, d), 10).drop("ranks")


@_query
def trace_summary(s: SparkSession, d: str) -> DataFrame:
    """Events read as traces of routed searches."""
    e = table(s, d, "events")
    one = F.lit(1).cast("long")
    traces = e.select(
        F.when(F.col("event_id") % 3 == 0, "decompose").otherwise("direct").alias("route"), (F.col("event_id") % 7 == 0).alias("route_fallback"), (F.col("event_id") % 6 == 0).alias("decompose_fallback"), (F.col("event_id") % 3 + 1).alias("n_sub_queries"),
        one.alias("llm_calls"), one.alias("cache_hits"), F.col("user_id").alias("prompt_tokens"), one.alias("completion_tokens"), F.col("value").alias("llm_seconds"), (F.col("value") / 4).alias("retrieval_seconds"),
    )
    out = agent.summarize_traces(traces)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@_query
def contexts(s: SparkSession, d: str) -> DataFrame:
    """Numbered passages of the fused lists."""
    run = top_n(table(s, d, "fused").select("query_id", "chunk_id", "best_rank").distinct(), ["query_id"], [F.col("best_rank"), F.col("chunk_id")], 10)
    c = generation.contexts(run.select("query_id", "rank", "chunk_id"), table(s, d, "chunks"))
    return c.select("query_id", F.size("chunk_ids").alias("n"), F.md5(F.array_join("chunk_ids", ",")).alias("ids_md5"), F.md5("context").alias("context_md5"))


def _answers(s: SparkSession, d: str) -> DataFrame:
    """An answer of each system to each query, made from the first chunks of its list: two citations, one of which may dangle."""
    heads = _runs(s, d).where("rank <= 3").groupBy("system", "query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"))
    n = F.regexp_extract("query_id", r"(\d+)$", 1).cast("int")
    body = F.concat(F.lit("See [C1] and [C"), (n % 5 + 1).cast("string"), F.lit("]."))
    raw = F.when(n % 11 == 0, F.lit('{"answer": "INSUFFICIENT_CONTEXT", "refused": true}')).when(n % 13 == 0, F.lit("no answer")).otherwise(F.to_json(F.struct(body.alias("answer"), F.lit(False).alias("refused"))))
    rows = heads.join(_asked(s, d), "query_id").withColumn("raw", raw)
    extra = {"model_seconds": n / 10.0, "retrieval_seconds": n / 100.0, "prompt_tokens": n.cast("long"), "completion_tokens": F.lit(5).cast("long")}
    return generation.answers(rows.withColumns(extra))


def _checked(s: SparkSession, d: str) -> DataFrame:
    a = _answers(s, d)
    n = F.regexp_extract("query_id", r"(\d+)$", 1).cast("int")
    claims = a.select("system", "query_id", F.lit('{"claims": ["one", " ", 2, "two", "three"]}').alias("raw"))
    support = a.select("system", "query_id", F.concat(F.lit('{"verdicts": [{"claim": 2, "supported": true, "passage": 1}, {"claim": "1", "supported": '), (n % 2 == 0).cast("string"), F.lit(', "passage": 9}, {"claim": 2, "supported": false}, {"claim": 7, "supported": true}]}')).alias("raw"))
    return generation.checked(a, claims, support)


@_query
def answer_summary(s: SparkSession, d: str) -> DataFrame:
    return generation.summarize_answers(_answers(s, d)).withColumn("mean_model_s", F.round("mean_model_s", 9))


@_query
def support_table(s: SparkSession, d: str) -> DataFrame:
    out = report.support_table(_checked(s, d))
    return out.withColumns({"rate_all": F.round("rate_all", 9), "rate_judged": F.round("rate_judged", 9)})


@_query
def citation_table(s: SparkSession, d: str) -> DataFrame:
    return report.citation_table(_checked(s, d)).withColumn("dangling_rate", F.round("dangling_rate", 9))


@_query
def check_summary(s: SparkSession, d: str) -> DataFrame:
    out = generation.summarize_checks(_checked(s, d))
    return out.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@_query
def refusal_table(s: SparkSession, d: str) -> DataFrame:
    """Refusals of every system, and how often it refused the passages of another query."""
    systems = _runs(s, d).select("system").distinct()
    n = F.regexp_extract("query_id", r"(\d+)$", 1).cast("int")
    probe = probe_pairs(s, d).withColumn("system", F.explode(F.array(*[F.lit(x) for x in SYSTEMS]))).join(systems, "system").select("system", "skipped", (n % 3 > 0).alias("refused"))
    return report.refusal_table(_checked(s, d), probe).withColumn("correct_refusal", F.round("correct_refusal", 9))


@_query
def route_prompts(s: SparkSession, d: str) -> DataFrame:
    """The prompt that asks for each title's route."""
    return prompts.route_requests(_titles(s, d), "m").select("query_id", F.md5("prompt").alias("prompt_md5"))


@_query
def answer_prompts(s: SparkSession, d: str) -> DataFrame:
    """The prompt that asks for an answer to each query from the passages of its fused list."""
    run = top_n(table(s, d, "fused").select("query_id", "chunk_id", "best_rank").distinct(), ["query_id"], [F.col("best_rank"), F.col("chunk_id")], 10)
    found = generation.contexts(run.select("query_id", "rank", "chunk_id"), table(s, d, "chunks"))
    asked = found.select("query_id", F.col("query_id").alias("query"))
    return prompts.answer_requests(found, asked, "m", "fused").select("query_id", F.size("chunk_ids").alias("n"), F.md5("prompt").alias("prompt_md5"))


@_query
def delta_report(s: SparkSession, d: str) -> DataFrame:
    """New and judged candidates of each query and of all."""
    return pooling.delta_totals(pooling.delta_counts(_pool(s, d), _judged(s, d), _asked(s, d)))


@_query
def support_intervals(s: SparkSession, d: str) -> DataFrame:
    return resample.ratio_intervals(resample.ratio_draws(report.support_pairs(_checked(s, d), True), "system"), "system")


def _rotation(s: SparkSession, d: str) -> DataFrame:
    # a query set is what people ask and judge; its number by id is the rotation's place
    from .ranking import position_by_bucket

    return position_by_bucket(_asked(s, d).select("query_id"), [], ["query_id"], "ord", buckets=1)


@_query
def mismatch_pairs(s: SparkSession, d: str) -> DataFrame:
    return generation.mismatch_pairs(_rotation(s, d))


@_query
def probe_pairs(s: SparkSession, d: str) -> DataFrame:
    """Pairs of the refusal probe, and whether the donor's pages answer the query."""
    pairs = generation.mismatch_pairs(_rotation(s, d))
    return generation.probe_pairs(pairs, _one_run(s, d), _page_map(s, d), generation.relevant_pages(_qrels(s, d), _url_map(s, d)))
