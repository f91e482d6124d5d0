"""Chunk files, judgments, pools, response caches, vector indexes and reports on disk.

What grows with the corpus is read and written by Spark. YAML and HTML, which people edit, are small:
they are read and written on the driver.
"""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import CHUNKS, conform

QUERIES = "query_id string, query string, category string, ord int"
QRELS = "query_id string, unit string, grade int, ord int"
POOL = "query_id string, query string, category string, cand_ord int, url string, title string, section string, snippet string, found_by string, grade int"
CACHE = "key string, text string, prompt_tokens long, completion_tokens long, seconds double, model string, query string, retriever string"


def write_jsonl(chunks: DataFrame, folder: str) -> None:
    chunks.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)


def read_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of JSON lines; blank lines are skipped, missing columns filled."""
    return conform(spark.read.schema(CHUNKS).json(folder).where("chunk_id IS NOT NULL"), CHUNKS)


def read_queries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, judgments) of a YAML list of queries; a missing list of judgments is empty."""
    import yaml

    body = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or []
    items = body.get("queries", []) if isinstance(body, dict) else body
    queries = [(q["id"], q["query"], q.get("category"), i) for i, q in enumerate(items)]
    units = [(q["id"], j["url"] + (f"#{j['anchor']}" if j.get("anchor") else ""), int(j["grade"]), i) for q in items for i, j in enumerate(q.get("judgments") or []) if j.get("grade") is not None]
    return spark.createDataFrame(queries, QUERIES), spark.createDataFrame(units, QRELS)


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    """Candidates of a pool file, one row each; ungraded ones with a null grade."""
    import yaml

    body = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    rows = [
        (qid, q.get("query"), q.get("category"), i, c.get("url"), c.get("title"), c.get("section"), c.get("snippet"), c["found_by"] if isinstance(c.get("found_by"), str) else ", ".join(c.get("found_by") or []), c.get("grade"))
        for qid, q in (body.get("queries") or {}).items()
        for i, c in enumerate(q.get("candidates") or [])
    ]
    return spark.createDataFrame(rows, POOL)


def write_pool(pool: DataFrame, path: str, built_by: list[str], k: int, note: str = "") -> int:
    """Write a pool (columns of POOL) as YAML for graders; the number of candidates. A pool is what people read, so it is collected."""
    import yaml

    queries: dict = {}
    n = 0
    for r in pool.orderBy("query_id", "cand_ord", "url").collect():
        q = queries.setdefault(r["query_id"], {"query": r["query"], "category": r["category"], "candidates": []})
        q["candidates"].append({"grade": r["grade"], **{c: r[c] for c in ("url", "title", "section", "snippet", "found_by")}})
        n += 1
    head = "".join(f"# {line}\n" for line in note.splitlines())
    Path(path).write_text(head + yaml.safe_dump({"built_by": built_by, "k": k, "queries": queries}, sort_keys=False, allow_unicode=True, width=100), encoding="utf-8")
    return n


def grading_ids(pool: DataFrame) -> DataFrame:
    """The pool with label ``qid-NN``, numbered within a query from 1."""
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("query_id").orderBy("cand_ord", "url"))
    return pool.withColumn("label", F.format_string("%s-%02d", "query_id", at))


def write_grading_page(pool: DataFrame, path: str) -> int:
    """A plain HTML form over the pool, one candidate a line with the three grades; the number of candidates."""
    rows = grading_ids(pool).orderBy("label").collect()
    parts = ["<!doctype html><meta charset=utf-8><title>Grading</title><form>"]
    last = None
    for r in rows:
        if r["query_id"] != last:
            last = r["query_id"]
            parts.append(f"<h2>{html.escape(r['query'] or '')}</h2>")
        radios = "".join(f"<label><input type=radio name={html.escape(r['label'], quote=True)} value={g}>{g}</label> " for g in (0, 1, 2))
        parts.append(f"<p id={html.escape(r['label'], quote=True)}><a href='{html.escape(r['url'] or '', quote=True)}'>{html.escape(r['title'] or '')}</a> {html.escape(r['section'] or '')}<br>{html.escape(r['snippet'] or '')}<br>{radios}</p>")
    Path(path).write_text("\n".join([*parts, "</form>"]), encoding="utf-8")
    return len(rows)


def read_grades(spark: SparkSession, path: str) -> DataFrame:
    """label, grade of lines ``qid-NN: grade``; other lines are skipped."""
    line = F.regexp_extract("value", r"^\s*([\w.-]+-\d+)\s*:\s*([0-2])\s*$", 0)
    lines = spark.read.text(path).where(line != "")
    return lines.select(F.regexp_extract("value", r"([\w.-]+-\d+)\s*:", 1).alias("label"), F.regexp_extract("value", r":\s*([0-2])", 1).cast("int").alias("grade"))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cached model responses of a keyed JSON file; a missing or broken file is an empty cache."""
    try:
        body = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        body = {}
    body = body if isinstance(body, dict) else {}
    rows = [(k, v.get("text"), v.get("prompt_tokens"), v.get("completion_tokens"), float(v.get("seconds") or 0), v.get("model"), v.get("query"), v.get("retriever")) for k, v in body.items() if isinstance(v, dict)]
    return spark.createDataFrame(rows, CACHE)


def write_cache(responses: DataFrame, path: str) -> int:
    """Add responses (the columns of ``CACHE``) to a keyed JSON file and return how many entries it has; the new ones win.

    A file in the old state or in the new one is seen, never half of it. Responses of a judged query set are few; they are read row by row.
    """
    try:
        body = json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        body = {}
    body = body if isinstance(body, dict) else {}
    for r in responses.toLocalIterator():
        body[r["key"]] = {c: r[c] for c in responses.columns if c != "key" and r[c] is not None}
    part = Path(f"{path}.part")
    part.parent.mkdir(parents=True, exist_ok=True)
    part.write_text(json.dumps(body, ensure_ascii=False, indent=1, sort_keys=True), encoding="utf-8")
    part.replace(path)
    return len(body)


def save_index(index: DataFrame, folder: str, model: str, dim: int, fingerprint: DataFrame) -> None:
    """Vectors (chunk_id, vec) and one row about them: model, dim, fingerprint."""
    index.write.mode("overwrite").parquet(f"{folder}/vectors")
    fingerprint.select(F.lit(model).alias("model"), F.lit(dim).alias("dim"), "fingerprint").write.mode("overwrite").parquet(f"{folder}/meta")


def load_index(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, meta) of an index; FileNotFoundError names what to build if it is missing."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/meta")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        raise FileNotFoundError(f"no vector index in {folder}; build one with dense.encode and files.save_index")
    return spark.read.parquet(f"{folder}/vectors"), spark.read.parquet(f"{folder}/meta")


def write_report(report: DataFrame, folder: str) -> None:
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(folder)
