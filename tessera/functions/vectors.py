"""Column expressions over vectors (arrays of numbers)."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile("[a-z0-9_]+")
_BUCKETS: dict[str, int] = {}


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    """Scalar product in double; null if a length differs or a value is null."""
    return F.when(F.size(_c(a)) == F.size(_c(b)), F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x))


def norm(v: str | Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: str | Column) -> Column:
    """The vector at length 1; a zero vector stays as it is. The length is computed once a row."""
    lengths = F.array(norm(v))
    return F.get(F.transform(lengths, lambda n: F.transform(_c(v), lambda x: x.cast("double") / F.when(n == 0, F.lit(1.0)).otherwise(n))), F.lit(0))


def hash_vectors(texts: pd.Series, is_query: bool = False, dim: int = 64) -> pd.Series:
    """A deterministic stand-in for an encoder: counts of a text's words by SHA-1 bucket. Null texts give zeros."""
    out = []
    for t in texts:
        v = [0.0] * dim
        for w in _WORD.findall((t or "").lower()):
            if w not in _BUCKETS:
                if len(_BUCKETS) > 500_000:
                    _BUCKETS.clear()
                _BUCKETS[w] = int(hashlib.sha1(w.encode()).hexdigest()[-8:], 16)
            v[_BUCKETS[w] % dim] += 1.0
        out.append(v)
    return pd.Series(out)
