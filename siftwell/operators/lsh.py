"""Approximate vector top-k by random-projection buckets (Spark ML), for one query against a large table.

Unit vectors make Euclidean distance a monotone function of cosine distance. Rows with null or zero vectors
are not indexed.
"""

from __future__ import annotations

from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.functions.vectors import l2_normalise, norm


def fit(vectors: DataFrame, vec_col: str = "embedding", tables: int = 4, bucket: float = 0.5, seed: int = 7):
    """(model, indexed rows) of a table of vectors of equal length."""
    unit = vectors.filter((F.size(vec_col) > 0) & (norm(F.col(vec_col)) > 0)).withColumn("features", array_to_vector(l2_normalise(F.col(vec_col))))
    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed)
    return lsh.fit(unit), unit


def approximate_top_k(model, indexed: DataFrame, query: list[float], k: int, id_col: str) -> DataFrame:
    found = model.approxNearestNeighbors(indexed, Vectors.dense(query), k, distCol="euclidean")
    return found.select(id_col, (F.col("euclidean") * F.col("euclidean") / 2).alias("distance"))
