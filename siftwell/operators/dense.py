"""Exact vector top-k.

One query is an expression over the scan and a top-k without shuffle of the table. Many queries are held as a
matrix by every task (in blocks of bounded size); each task keeps its own k best per query, so that only
tasks times queries times k rows are shuffled. ``siftwell.operators.lsh`` has the approximate way.

Null, zero and unequal vectors score as cosine 0 (score 0.5); ties rank by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from siftwell.functions.vectors import cosine, distance_to_score
from siftwell.session import spread

#: Numbers in one block of the query matrix.
BLOCK_FLOATS = 4_000_000


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str, vec_col: str = "embedding", where: Column | None = None) -> DataFrame:
    """(id, distance, score, rank) of the k nearest; ``where`` is applied before the limit, at the scan."""
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = vectors if where is None else vectors.filter(where)
    scored = rows.select(F.col(id_col), (1 - cosine(F.col(vec_col), q)).alias("distance"))
    best = scored.orderBy("distance", id_col).limit(max(1, k))
    return best.select(
        id_col, "distance", distance_to_score(F.col("distance")).alias("score"),
        F.row_number().over(Window.orderBy("distance", id_col)).alias("rank"),
    )


def top_k_multi(
    vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", query_id: str = "query_id",
    exclude_self: bool = True, threshold: float | None = None,
) -> DataFrame:
    """(query_id, id, cos, rank): for each query (query_id, embedding) the k most similar vectors.

    The queries are collected in blocks by hash of their id; each block is one pass over the vectors. Queries with
    null, zero or empty vectors have no result, as have vectors of another length."""
    usable = queries.select(query_id, vec_col).filter(f"{query_id} IS NOT NULL AND size({vec_col}) > 0")
    n, dim = usable.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size(vec_col)), F.lit(1))).first()
    blocks = max(1, -(-n * dim // BLOCK_FLOATS))
    sc = vectors.sparkSession.sparkContext
    kind = to_arrow_type(vectors.schema[id_col].dataType)
    qkind = to_arrow_type(queries.schema[query_id].dataType)
    ddl = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {id_col} {vectors.schema[id_col].dataType.simpleString()}, cos double"
    rows = spread(vectors.select(id_col, vec_col).filter(f"{id_col} IS NOT NULL AND size({vec_col}) > 0"))
    out = None
    for b in range(blocks):
        mine = usable.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b) if blocks > 1 else usable
        by_dim: dict[int, tuple[list, list]] = {}
        for q, v in sorted((tuple(r) for r in mine.collect()), key=lambda r: r[0]):
            a = np.asarray([np.nan if x is None else x for x in v], float)
            size = np.linalg.norm(a)
            if np.isfinite(size) and size > 0:
                ids, mat = by_dim.setdefault(len(a), ([], []))
                ids.append(q)
                mat.append(a / size)
        held = sc.broadcast({d: (ids, np.array(m)) for d, (ids, m) in by_dim.items()})

        def scan(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            kept: dict = {}
            for batch in batches:
                column = batch.column(1)
                ends = column.offsets.to_numpy()
                flat = column.values.to_numpy(zero_copy_only=False).astype(float)
                lengths, ids = np.diff(ends), batch.column(0).to_pylist()
                for dim, (qids, q) in held.value.items():
                    at = np.flatnonzero(lengths == dim)
                    if not len(at):
                        continue
                    m = flat[ends[at][:, None] + np.arange(dim)]
                    size = np.linalg.norm(m, axis=1)
                    good = np.isfinite(size) & (size > 0)
                    at, m, size = at[good], m[good], size[good]
                    s = np.round(q @ (m / size[:, None]).T, 9)
                    take = min(len(at), k + (1 if exclude_self else 0) + 32)
                    for i, query in enumerate(qids):
                        row = s[i]
                        cut = np.partition(row, len(row) - take)[len(row) - take] if take < len(row) else -2
                        if threshold is not None:
                            cut = max(cut, threshold)
                        best = kept.setdefault((dim, i), [])
                        best += [(-row[j], ids[at[j]]) for j in np.flatnonzero(row >= cut) if not (exclude_self and ids[at[j]] == query)]
                        if len(best) > 4 * k:
                            best.sort()
                            del best[k:]
            q, v, c = [], [], []
            for (dim, i), best in kept.items():
                for x, other in sorted(best)[:k]:
                    q.append(held.value[dim][0][i])
                    v.append(other)
                    c.append(-x)
            yield pa.record_batch([pa.array(q, qkind), pa.array(v, kind), pa.array(c, pa.float64())], [query_id, id_col, "cos"])

        part = rows.mapInArrow(scan, ddl)
        out = part if out is None else out.unionByName(part)
    best = Window.partitionBy(query_id).orderBy(F.desc("cos"), id_col)
    return out.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
