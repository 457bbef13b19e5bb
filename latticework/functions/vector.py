"""Vector expressions: everything is reduced in double precision, in the JVM but for the hashed embedder."""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Java's \\s is.
_BLANK = re.compile(r"[ \t\n\x0b\f\r]+")


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def _over(v: Column, n: Column) -> Column:
    """v / n, where n is bound as a variable, so that it is computed once and not for each element."""
    return F.transform(F.array(n), lambda k: F.transform(doubles(v), lambda x: x / k))[0]


def unit(v: Column) -> Column:
    """Of length 1; a zero vector stays."""
    n = norm(doubles(v))
    return _over(v, F.when(n == 0, F.lit(1.0)).otherwise(n))


def query_unit(v: Column) -> Column:
    return _over(v, F.greatest(norm(doubles(v)), F.lit(1e-12)))


def cosine(unit_a: Column, unit_b: Column) -> Column:
    return dot(unit_a, unit_b)


def hashed_embedding(text: Column, dim: int = 32) -> Column:
    """Counts of lower-case words by crc32 modulo dim, of length 1: an embedder without a model.

    Arrow batches: as expressions this takes a pass over the words for each
    dimension. A null text has a zero vector.
    """
    return _hashed(dim)(F.lower(text))


@lru_cache
def _hashed(dim: int):
    @F.pandas_udf("array<double>")
    def embed(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            slots = [zlib.crc32(w.encode("utf-8", "replace")) % dim for w in _BLANK.split(t or "") if w]
            n = np.bincount(np.array(slots, np.int64), minlength=dim).astype(float)
            out.append(n / max(np.linalg.norm(n), 1e-300))
        return pd.Series(out, dtype=object)

    return embed


#: Models that this worker has loaded, by embedder.
_models: dict[str, Callable[[list[str]], np.ndarray]] = {}


def model_embedder(load: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 64) -> Callable[[Column], Column]:
    """An embedder from a function that loads a model of list[str] -> matrix: once in each Python worker, in batches, unit vectors of float32.

    A null text gets no vector; a zero row stays as it is.
    """
    from pyspark.sql import SparkSession

    from latticework.session import ship

    ship(SparkSession.active())
    key = uuid.uuid4().hex

    @F.pandas_udf("array<float>")
    def embed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from latticework.functions import vector

        if key not in vector._models:
            vector._models[key] = load()
        model = vector._models[key]
        for s in texts:
            out = pd.Series([None] * len(s), dtype=object)
            some = np.flatnonzero(s.notna())
            for k in range(0, len(some), batch):
                at = some[k : k + batch]
                x = np.asarray(model(s.iloc[at].tolist()), np.float64)
                x = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) > 0, n, 1)
                for i, v in zip(at, x.astype(np.float32)):
                    out.iat[i] = v
            yield out

    return embed
