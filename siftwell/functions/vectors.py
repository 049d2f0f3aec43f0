"""Vector arithmetic on array columns, in double precision.

These expressions stay in the JVM; for many queries against many vectors ``operators.dense`` uses matrix
products instead. Null, empty, zero and unequal vectors have similarity 0.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-9


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine(a: Column, b: Column) -> Column:
    size = norm(a) * norm(b)
    usable = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b)) & (size > 0)
    return F.when(usable, dot(a, b) / size).otherwise(0.0)


def distance_to_score(distance: Column) -> Column:
    """Cosine distance 0..2 to a score 1..0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / 2))


def l2_normalise(a: Column) -> Column:
    return F.transform(a, lambda x: (x.cast("double") / F.greatest(norm(a), F.lit(EPS))).cast("float"))


def cosine_scalar(a: list[float] | None, b: list[float] | None) -> float:
    if not a or not b or len(a) != len(b):
        return 0.0
    x, y = np.asarray(a, float), np.asarray(b, float)
    size = np.linalg.norm(x) * np.linalg.norm(y)
    return float(x @ y / size) if size > 0 else 0.0


def masked_mean(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the tokens of each row where the mask is set: (rows, tokens, width), (rows, tokens)."""
    m = mask[..., None].astype(hidden.dtype)
    return (hidden * m).sum(1) / np.maximum(m.sum(1), EPS)


def unit_rows(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), EPS)
