"""Chunks that arrive as a stream of files: each micro-batch is upserted into a versioned corpus.

Pages and their chunks lie in buckets by the hash of the url. A version writes the buckets that its batch touches, and a
list of where the newest files of every bucket are; so a batch costs what it touches, not the corpus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.upsert import load
from ..plans.shared import materialize, release
from ..sources.schemas import CHUNKS, PAGES

#: Buckets of a corpus; fixed when it is made.
BUCKETS = 64


def _files(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _version(spark: SparkSession, folder: str) -> int:
    """The last complete version of the corpus in a folder; -1 if there is none. The list of buckets is written last."""
    fs, path = _files(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    return max((int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(_files(spark, f"{folder}/{n}/buckets/_SUCCESS")[1])), default=-1)


def _buckets(spark: SparkSession, folder: str, version: int) -> tuple[dict[int, int], int]:
    """(bucket to the version that wrote it last, last load_seq) of a version: at most ``BUCKETS`` rows."""
    if version < 0:
        return {}, -1
    rows = spark.read.parquet(f"{folder}/v{version}/buckets").collect()
    return {r["bucket"]: r["version"] for r in rows if r["bucket"] >= 0}, max(r["last_seq"] for r in rows)


def _read(spark: SparkSession, folder: str, where: dict[int, int], name: str, schema) -> DataFrame:
    fs, _ = _files(spark, folder)
    paths = [p for b, v in sorted(where.items()) if fs.exists(_files(spark, p := f"{folder}/v{v}/{name}/bucket={b}")[1])]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_corpus(spark: SparkSession, folder: str, version: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, chunks) of a version, the last by default; empty tables if there is none."""
    where, _ = _buckets(spark, folder, _version(spark, folder) if version is None else version)
    return _read(spark, folder, where, "pages", PAGES), _read(spark, folder, where, "chunks", CHUNKS)


def bucket(url: str = "url"):
    return F.pmod(F.xxhash64(url), F.lit(BUCKETS)).cast("int")


def upsert_batch(batch: DataFrame, folder: str, version: int) -> None:
    """Write ``version`` of a corpus: the version before with a batch of chunks upserted. Run again it writes the same over.

    Touched are the buckets of the batch's urls and those in which its chunk_ids lie under other urls.
    """
    spark = batch.sparkSession
    before, last = _buckets(spark, folder, min(version - 1, _version(spark, folder)))
    batch = materialize(batch, "batch")
    ids = batch.select("chunk_id").where("chunk_id IS NOT NULL").distinct()
    lying = _read(spark, folder, before, "chunks", CHUNKS).select("chunk_id", "url").join(ids, "chunk_id", "left_semi").select("url")
    urls = batch.select("url").where("url IS NOT NULL").unionByName(lying)
    touched = {r["b"] for r in urls.select(bucket().alias("b")).distinct().collect()}  # at most BUCKETS
    old = {b: v for b, v in before.items() if b in touched}
    out = load(_read(spark, folder, old, "pages", PAGES), _read(spark, folder, old, "chunks", CHUNKS), batch, last_seq=last)
    for name, rows in (("pages", out.pages), ("chunks", out.chunks)):
        rows.withColumn("bucket", bucket()).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/v{version}/{name}")
    where = before | dict.fromkeys(touched, version)
    now = _read(spark, folder, dict.fromkeys(touched, version), "chunks", CHUNKS).agg(F.max("load_seq")).first()[0]
    rows = [(b, v, max(last, -1 if now is None else now)) for b, v in sorted(where.items())] or [(-1, -1, last)]
    spark.createDataFrame(rows, "bucket int, version int, last_seq long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/v{version}/buckets")
    release(batch)


def upsert_stream(source: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Upsert every micro-batch of a stream of chunks.

    Batch n writes version n from the version before, so a batch that is run again after a failure writes the same
    version over. Readers see whole versions.
    """
    return source.writeStream.foreachBatch(lambda batch, n: upsert_batch(batch, folder, n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
