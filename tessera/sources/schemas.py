"""Schemas of the corpus tables and adding what an older table lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGES = T.StructType().add("url", "string").add("title", "string").add("source", "string").add("version", "string").add("fetched_at", "string").add("n_chunks", "integer").add("canonical_url", "string").add("status", "string")
CHUNKS = (
    T.StructType().add("chunk_id", "string").add("url", "string").add("anchor", "string").add("title", "string").add("heading_path", T.ArrayType(T.StringType()))
    .add("ordinal", "integer").add("text", "string").add("n_tokens", "integer").add("content_hash", "string").add("load_seq", "long")
)
#: What a missing column or a null in these columns is filled with; other missing columns become null.
FILL = {"canonical_url": "", "status": "ok", "load_seq": 0}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns, cast; missing ones are added, others left out."""
    kept = []
    for f in schema.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(FILL.get(f.name))
        c = c.cast(f.dataType)
        kept.append((F.coalesce(c, F.lit(FILL[f.name])) if f.name in FILL else c).alias(f.name))
    return df.select(*kept)
