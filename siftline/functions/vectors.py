"""Expressions over vectors (arrays of float): similarity, normalisation, hash embedding."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FAR = 3.4028234663852886e38  # the greatest float: no distance is defined


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _comparable(a: Column, b: Column) -> Column:
    return a.isNotNull() & b.isNotNull() & (F.size(a) == F.size(b)) & (F.size(a) > 0)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double; 0 for vectors of different, no or zero length."""
    lengths = norm(a) * norm(b)
    return F.when(_comparable(a, b) & (lengths > 0), dot(a, b) / F.when(lengths > 0, lengths)).otherwise(F.lit(0.0))


def distance(a: Column, b: Column) -> Column:
    """1 - cosine; the greatest float where none is defined."""
    lengths = norm(a) * norm(b)
    return F.when(_comparable(a, b) & (lengths > 0), 1 - dot(a, b) / F.when(lengths > 0, lengths)).otherwise(F.lit(FAR))


def similarity(d: Column) -> Column:
    """1 - distance, never below 0."""
    return F.when(d >= 1, F.lit(0.0)).otherwise(1 - d)


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once a row instead of once for each use in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_normalised(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return _let(F.struct(a.alias("a"), norm(a).alias("n")), lambda v: F.when(v["n"] > 0, F.transform(v["a"], lambda x: (x.cast("double") / v["n"]).cast("float"))).otherwise(v["a"]))


def hash_embedding(text: Column, dim: int, prefix: str = "") -> Column:
    """A deterministic unit vector from the SHA-256 of the text, with a period of 14."""

    def value(h: Column, i: int) -> Column:
        o = (2 * i) % 28
        little = F.concat(*[F.substring(h, 2 * (o + k) + 1, 2) for k in (3, 2, 1, 0)])
        n = F.conv(little, 16, 10).cast("long")
        return (F.when(n >= 2**31, n - 2**32).otherwise(n).cast("float") / F.lit(1e9).cast("float")).cast("float")

    digest = F.sha2(F.concat(F.lit(prefix), text).cast("binary"), 256)
    seeds = _let(digest, lambda h: F.array(*[value(h, i) for i in range(14)]))
    return l2_normalised(_let(seeds, lambda s: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.element_at(s, (i % 14 + 1).cast("int")))))


def hash_vector(text: str, dim: int, prefix: str = "") -> list[float]:
    """The same for one text, on the driver."""
    import hashlib

    h = hashlib.sha256((prefix + text).encode()).digest()
    v = np.array([np.float32(int.from_bytes(h[(2 * i) % 28 : (2 * i) % 28 + 4], "little", signed=True)) / np.float32(1e9) for i in range(14)], np.float32)
    x = v[np.arange(dim) % 14].astype(np.float64)
    n = np.sqrt((x * x).sum())
    return [float(np.float32(y)) for y in (x / n if n > 0 else x)]


def cosine_to(query: list[float]):
    """A vectorised cosine of a column with one query vector, for scans of many long vectors."""
    q = np.array(query, np.float64)
    length = float(np.sqrt((q * q).sum()))

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        out = np.zeros(len(v))
        at = [i for i, x in enumerate(v) if x is not None and len(x) == len(q)]
        if at and length > 0:
            x = np.stack([v.iloc[i] for i in at]).astype(np.float64)
            n = np.sqrt((x * x).sum(axis=1))
            out[at] = np.where(n > 0, x @ q / np.where(n > 0, n * length, 1), 0.0)
        return pd.Series(out)

    return score
