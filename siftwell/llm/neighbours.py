"""Most similar vectors for every vector (problem 1): a hash-prefix forest.

Each of ``trees`` trees gives a vector a string of ``BITS`` sign bits of random projections and keeps
all strings sorted, so that the strings with a common prefix are an interval of the array. A vector descends to
its longest-prefix matches in each tree and ascends in all trees at once, one bit shorter at a time, until the
intervals of all trees together hold ``target`` others; the length reached is the vector's level, and all in its
intervals (at most ``width`` places to either side in a tree, nearest first) are its candidates.

The sizes of intervals are estimated from the sorted strings of a bounded sample (about ``SAMPLE`` vectors by hash of id, twice as many at most, scaled to
the number of rows), so the level is known before anything is shuffled. The sample's quantiles also cut each tree
into segments of about ``ROWS`` rows (by string, then id, so that equal strings are cut as well). A row whose
interval reaches over a cut, and that lies near it, is sent to the segment beyond as well, so no pair is lost there
and the result doesn't depend on how many tasks share the segments. The trees carry vectors of eight-bit
components; whatever comes near ``min_cos`` is scored again exactly.

Vectors of equal direction (components equal to five decimals after scaling) are one class; the
forest holds one representative of each, so copies cost nothing however many there are.

Defined results: null, empty and all-zero embeddings and such with null, NaN or infinite components
take no part; vectors of different lengths are never compared; rows with null ids take no part;
a repeated id stands for its first vector in byte order; equal similarities (to six decimals) rank
by id; columns beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.session import spread

TREES = 24
BITS = 64
WIDTH = 48
#: Candidates in all trees together at which the ascent stops.
TARGET = 600
#: Vectors whose strings are held by every task to estimate the sizes of intervals.
SAMPLE = 16_384
#: Rows of a segment, as long as the sample can tell that many segments apart.
ROWS = 32_768
SEED = 20240611
#: Eight-bit cosines are off by less than this for vectors of a few dozen components or more.
SLACK = 0.02


def _planes(dim: int, trees: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, trees * BITS)).astype(np.float32)


def _blob(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as a column of bytes."""
    raw = np.ascontiguousarray(rows)
    width = raw.shape[1] * raw.itemsize
    offsets = pa.py_buffer(np.arange(0, (len(raw) + 1) * width, width, dtype=np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, offsets, pa.py_buffer(raw.tobytes())])


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    flat = np.frombuffer(b"".join(column.to_pylist()), dtype=kind)
    return flat.reshape(len(column), -1)


def usable_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, dim, same, unit): usable rows, with the class key ``same`` and the unit vector as bytes of float32."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter("id IS NOT NULL AND size(v) > 0 AND NOT exists(v, x -> x IS NULL)")

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, column = batch.column(0).to_numpy(), batch.column(1)
            ends = column.offsets.to_numpy()
            flat, lengths = column.values.to_numpy(zero_copy_only=False), np.diff(ends)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                m = flat[ends[at][:, None] + np.arange(dim)]
                with np.errstate(all="ignore"):
                    m = m / np.abs(m).max(1, keepdims=True)
                    m = m / np.linalg.norm(m, axis=1, keepdims=True)
                good = np.isfinite(m).all(1)
                at, m = at[good], m[good]
                if not len(at):
                    continue
                rounded = np.round(m, 5) + 0.0
                keys = [xxhash.xxh3_128_hexdigest(r.tobytes()) for r in rounded]
                yield pa.record_batch(
                    [pa.array(ids[at]), pa.array(np.full(len(at), dim, np.int32)), pa.array(keys), _blob(m.astype(np.float32))],
                    ["id", "dim", "same", "unit"],
                )

    return spread(rows).mapInArrow(units, "id bigint, dim int, same string, unit binary")


def representatives(units: DataFrame) -> DataFrame:
    """The row with the smallest id of each class."""
    return units.groupBy("dim", "same").agg(F.min(F.struct("id", "unit")).alias("m")).select("m.id", "dim", "m.unit")


def _planted(reps: DataFrame, trees: int, partitions: int | None) -> DataFrame:
    """(tree, hash, id, low) of every representative in every tree, the trees sorted by hash string."""

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                ids = batch.column(0).to_numpy()[at]
                m = _matrix(batch.column(2).take(pa.array(at)), np.float32)
                bits = np.packbits(m @ _planes(int(dim), trees) > 0, axis=1).reshape(len(at), trees, BITS // 8)
                low = np.round(m * (127 / np.abs(m).max(1, keepdims=True))).astype(np.int8)
                for t in range(trees):
                    yield pa.record_batch(
                        [
                            pa.array(np.full(len(at), dim * trees + t, np.int32)),
                            pa.array(bits[:, t].copy().view(">i8")[:, 0].astype(np.int64)),
                            pa.array(ids),
                            _blob(low),
                        ],
                        ["tree", "hash", "id", "low"],
                    )

    planted = reps.select("id", "dim", "unit").mapInArrow(plant, "tree int, hash bigint, id bigint, low binary")
    parts = partitions or max(trees, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return planted.repartitionByRange(parts, "tree", "hash", "id").sortWithinPartitions("tree", "hash", "id")


def _strings(m: np.ndarray, dim: int, trees: int) -> np.ndarray:
    """(rows, trees): the hash strings as numbers that sort as the strings do."""
    bits = np.packbits(m @ _planes(dim, trees) > 0, axis=1).reshape(len(m), trees, BITS // 8)
    return bits.copy().view(">u8")[:, :, 0].astype(np.uint64)


def _interval(strings: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last string with the same first ``levels`` bits."""
    rest = np.where(levels <= 0, np.uint64(2**64 - 1), (np.uint64(1) << (BITS - np.clip(levels, 1, BITS)).astype(np.uint64)) - np.uint64(1))
    return strings & ~rest, strings | rest


class Forest:
    """Sorted strings of a sample of ``n`` vectors of one length, tree by tree."""

    def __init__(self, ids: np.ndarray, unit: np.ndarray, n: int, trees: int, target: int, width: int):
        dim = unit.shape[1]
        strings = _strings(unit, dim, trees)
        self.trees, self.target, self.scale = trees, target, max(1.0, n / max(1, len(ids)))
        segments = max(1, min(-(-n // ROWS), len(ids) // 16))
        self.near = int(2 * width / self.scale) + 8  # places of the sample that ``width`` rows may take
        self.order, self.cuts = [], []
        for t in range(trees):
            at = np.lexsort((ids, strings[:, t]))
            self.order.append(strings[at, t])
            cut = at[(np.arange(1, segments) * len(at)) // segments]
            self.cuts.append((strings[cut, t], ids[cut]))

    def levels(self, strings: np.ndarray) -> np.ndarray:
        """For each row the longest prefix at which its intervals of all trees hold ``target`` vectors."""
        low, high = np.zeros(len(strings), np.int64), np.full(len(strings), BITS, np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            held = np.zeros(len(strings))
            for t in range(self.trees):
                first, last = _interval(strings[:, t], mid)
                held += np.searchsorted(self.order[t], last, "right") - np.searchsorted(self.order[t], first, "left")
            enough = held * self.scale >= self.target + self.trees
            low, high = np.where(enough, mid, low), np.where(enough, high, mid - 1)
        return low

    def segments(self, t: int, strings: np.ndarray, ids: np.ndarray, levels: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, bool]]:
        """(rows, segments, whether they are guests): where the rows of tree ``t`` go."""
        cut, cut_ids = self.cuts[t]
        own = np.searchsorted(cut, strings, "left")
        while len(tied := np.flatnonzero((own < len(cut)) & (cut[np.minimum(own, len(cut) - 1)] == strings) & (cut_ids[np.minimum(own, len(cut) - 1)] <= ids))) if len(cut) else ():
            own[tied] += 1
        out = [(np.arange(len(ids)), own, False)]
        if len(cut):
            first, last = _interval(strings, levels)
            place, ends = np.searchsorted(self.order[t], strings, "left"), np.searchsorted(self.order[t], strings, "right")
            where = (np.searchsorted(self.order[t], cut, "left"), np.searchsorted(self.order[t], cut, "right"))
            for side, bound in ((-1, own - 1), (1, own)):
                at = np.clip(bound, 0, len(cut) - 1)
                close = (place - self.near <= where[1][at]) & (ends + self.near >= where[0][at])
                over = (first <= cut[at]) if side < 0 else (last >= cut[at])
                rows = np.flatnonzero((bound >= 0) & (bound < len(cut)) & close & over)
                out.append((rows, own[rows] + side, True))
        return out


def fit_forest(units: DataFrame, trees: int, target: int, width: int) -> dict[int, Forest]:
    """A forest for each length of vectors, from about ``SAMPLE`` vectors of it (fewer where many are copies)."""
    counts = {r.dim: r.n for r in units.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = {}
    for dim, n in sorted(counts.items()):
        mine = units.filter(F.col("dim") == dim).select("id", "same", "unit")
        share = int(min(1.0, SAMPLE / n) * 2**30)
        rows = sorted(mine.filter(F.pmod(F.xxhash64("id"), F.lit(2**30)) < share).limit(2 * SAMPLE).collect(), key=lambda r: (r.id, r.same))
        once = {r.same: r for r in reversed(rows)}.values()
        unit = np.frombuffer(b"".join(bytes(r.unit) for r in once), np.float32).reshape(len(once), dim)
        out[dim] = Forest(np.array([r.id for r in once], np.int64), unit, max(len(once), n * len(once) // len(rows)), trees, target, width)
    return out


def forest_pairs(
    reps: DataFrame, min_cos: float, trees: int = TREES, width: int = WIDTH, partitions: int | None = None, target: int | None = None, units: DataFrame | None = None
) -> DataFrame:
    """(a, b, cos): pairs of representatives, a < b, of which one is a candidate of the other and whose cosine is at
    least ``min_cos``. ``units`` are the rows that ``reps`` stand for, from which the sample is taken without a shuffle."""
    units = reps.withColumn("same", F.col("id").cast("string")) if units is None else units
    target = target or TARGET * trees * width // (TREES * WIDTH)
    forest = reps.sparkSession.sparkContext.broadcast(fit_forest(units, trees, target, width))  # at most SAMPLE strings a tree and length

    def plant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                ids = batch.column(0).to_numpy()[at]
                m = _matrix(batch.column(2).take(pa.array(at)), np.float32)
                f, strings = forest.value[int(dim)], _strings(m, int(dim), trees)
                levels = f.levels(strings)
                low = np.round(m * (127 / np.abs(m).max(1, keepdims=True))).astype(np.int8)
                for t in range(trees):
                    for rows, segment, guest in f.segments(t, strings[:, t], ids, levels):
                        if len(rows):
                            yield pa.record_batch(
                                [
                                    pa.array(np.full(len(rows), dim * trees + t, np.int32)), pa.array(segment.astype(np.int32)), pa.array((strings[rows, t] ^ np.uint64(1 << 63)).view(np.int64)),
                                    pa.array(ids[rows]), pa.array(levels[rows].astype(np.int8)), pa.array(np.full(len(rows), guest)), _blob(low[rows]),
                                ],
                                ["tree", "segment", "hash", "id", "level", "guest", "low"],
                            )

    def pairs_of(strings: np.ndarray, ids: np.ndarray, levels: np.ndarray, guest: np.ndarray, low: np.ndarray) -> pa.RecordBatch | None:
        n, place = len(ids), np.arange(len(ids))
        first, last = _interval(strings, levels)
        left = np.minimum(place - np.searchsorted(strings, first, "left"), width)
        right = np.minimum(np.searchsorted(strings, last, "right") - 1 - place, width)
        m = low.astype(np.float32)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        a, b = [], []
        for step in range(1, min(width, n - 1) + 1):
            at = np.flatnonzero(((right[: n - step] >= step) | (left[step:] >= step)) & ~(guest[: n - step] & guest[step:]))
            at = at[np.einsum("ij,ij->i", m[at], m[at + step]) >= min_cos - SLACK]
            a.append(ids[at])
            b.append(ids[at + step])
        if not a:
            return None
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        key = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held and (got := pairs_of(*(np.concatenate(x) for x in zip(*held)))) is not None:
                yield got
            held.clear()

        for batch in batches:
            keys = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(keys)) + 1
            for start, stop in zip([0, *edges], [*edges, len(keys)]):
                if keys[start] != key:
                    yield from flush()
                    key = keys[start]
                part = batch.slice(start, stop - start)
                strings = part.column(2).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
                held.append([strings, part.column(3).to_numpy(), part.column(4).to_numpy().astype(np.int64), part.column(5).to_numpy(zero_copy_only=False), _matrix(part.column(6), np.int8)])
        yield from flush()

    planted = reps.select("id", "dim", "unit").mapInArrow(plant, "tree int, segment int, hash bigint, id bigint, level byte, guest boolean, low binary")
    parts = partitions or max(trees, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    segments = planted.repartition(parts, "tree", "segment").sortWithinPartitions("tree", "segment", "hash", "id")
    met = segments.mapInArrow(scan, "a bigint, b bigint").distinct()
    return exact_cosines(met, reps).filter(F.col("cos") >= min_cos)


def exact_cosines(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the cosine of their unit vectors, to six decimals."""
    v = reps.select("id", "unit")
    both = pairs.join(v.withColumnsRenamed({"id": "a", "unit": "u"}), "a").join(
        v.withColumnsRenamed({"id": "b", "unit": "w"}), "b"
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, w = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            cos = [float(np.dot(np.frombuffer(x, np.float32).astype(float), np.frombuffer(y, np.float32))) for x, y in zip(u, w)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(np.round(cos, 6), pa.float64())], ["a", "b", "cos"])

    return both.select("a", "b", "u", "w").mapInArrow(score, "a bigint, b bigint, cos double")


def similar_pairs(vectors: DataFrame, min_cos: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", **forest) -> tuple[DataFrame, DataFrame]:
    """Pairs of representatives (a, b, cos) and membership (id, rep, copies) of every usable row."""
    units = usable_vectors(vectors, id_col, vec_col)
    reps = representatives(units)
    rep = units.groupBy("dim", "same").agg(F.min("id").alias("rep"), F.countDistinct("id").alias("copies"))
    members = units.select("id", "dim", "same").join(rep, ["dim", "same"]).select("id", "rep", "copies").distinct()
    return forest_pairs(reps, min_cos, units=units, **forest), members


def mutual_pairs(vectors: DataFrame, k: int = 10, min_cos: float = 0.9, id_col: str = "vec_id", vec_col: str = "embedding", **forest) -> DataFrame:
    """(vec_lo, vec_hi): rows each among the other's ``k`` most similar, with cosine of at least ``min_cos``.

    Of a class of copies only the ``k + 1`` smallest ids can be among anyone's ``k`` most similar (ties rank
    by id), so only they are expanded; the window's limit is applied before the shuffle."""
    units = usable_vectors(vectors, id_col, vec_col)
    reps = representatives(units)
    pairs = forest_pairs(reps, min_cos, units=units, **forest)
    first = Window.partitionBy("dim", "same").orderBy("id")
    heads = (
        units.select("id", "dim", "same")
        .withColumn("n", F.rank().over(first))
        .filter(F.col("n") <= k + 1)
        .distinct()
        .groupBy("dim", "same")
        .agg(F.min("id").alias("rep"), F.sort_array(F.collect_set("id")).alias("ids"))  # at most k + 1
        .select("rep", "ids")
    )
    inside = heads.filter(F.size("ids") > 1).select(F.col("ids").alias("x"), F.col("ids").alias("y"), F.lit(1.0).alias("cos"))
    across = (
        pairs.join(heads.withColumnsRenamed({"rep": "a", "ids": "x"}), "a")
        .join(heads.withColumnsRenamed({"rep": "b", "ids": "y"}), "b")
        .select("x", "y", "cos")
    )
    # at most (k + 1) ** 2 rows for a link between classes, both directions
    links = inside.unionByName(across).unionByName(across.select(F.col("y").alias("x"), F.col("x").alias("y"), "cos"))
    links = links.select(F.explode("x").alias("id"), "y", "cos").select("id", F.explode("y").alias("other"), "cos").filter("id <> other")
    best = Window.partitionBy("id").orderBy(F.desc("cos"), "other")
    top = links.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k)
    both = top.select(F.least("id", "other").alias("vec_lo"), F.greatest("id", "other").alias("vec_hi"))
    return both.groupBy("vec_lo", "vec_hi").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").drop("n")


def _reach(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place how many places to the left and to the right hold its ``width`` longest-prefix matches."""
    n = len(hashes)
    h = hashes.view(np.uint64)
    left, at = np.zeros(n, np.int64), np.arange(n)
    for step in range(1, width + 1):  # the step-th to the left counts if its prefix is no shorter than what it would replace on the right
        a, b = at - step, at + (width + 1 - step)
        nearer = np.where(b < n, (h ^ h[np.maximum(a, 0)]) <= (h ^ h[np.minimum(b, n - 1)]), True)
        left += (a >= 0) & nearer
    right = np.minimum(width - left, n - 1 - at)
    return left, right


def forest_candidates(reps: DataFrame, keep: int, trees: int = TREES, width: int | None = None, partitions: int | None = None) -> DataFrame:
    """(a, b), a < b: for every representative, in every tree, its ``width`` longest-prefix matches are candidates,
    and the ``keep`` nearest of all trees by eight-bit cosine come out, whatever their cosine is. Without a
    ``width`` it grows with the number of representatives, as equal recall asks."""
    block = 256
    n = reps.count()
    width = width or max(2 * WIDTH, round(0.4 * n**0.8))

    def nearest(hashes: np.ndarray, ids: np.ndarray, low: np.ndarray, first: int, last: int) -> pa.RecordBatch:
        left, right = _reach(hashes, width)
        m = low.astype(np.float32)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        others, scores = [], []
        for b in range(first, last, block):
            e = min(b + block, last)
            lo, hi = max(0, int((np.arange(b, e) - left[b:e]).min())), int((np.arange(b, e) + right[b:e]).max()) + 1
            at, place = np.arange(b, e)[:, None], np.arange(lo, hi)[None, :]
            cos = m[b:e] @ m[lo:hi].T
            cos[(place < at - left[b:e, None]) | (place > at + right[b:e, None]) | (place == at)] = -2
            if cos.shape[1] < keep:
                cos = np.pad(cos, ((0, 0), (0, keep - cos.shape[1])), constant_values=-2)
            top = np.argpartition(-cos, keep - 1, axis=1)[:, :keep]
            score = np.take_along_axis(cos, top, axis=1)
            others.append(np.where(score > -2, ids[np.minimum(top + lo, len(ids) - 1)], -1))
            scores.append(np.where(score > -2, score, -2).astype(np.float32))
        return pa.record_batch([pa.array(ids[first:last]), _blob(np.concatenate(others)), _blob(np.concatenate(scores))], ["id", "others", "scores"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        tree, done = None, 0  # rows of ``held`` that are only context
        for batch in batches:
            t_col = batch.column(0).to_numpy()
            for t in np.unique(t_col):
                at = np.flatnonzero(t_col == t)
                part = batch.slice(at[0], len(at))
                rows = [part.column(1).to_numpy(), part.column(2).to_numpy(), _matrix(part.column(3), np.int8)]
                if tree is not None and t != tree:
                    yield nearest(*held, done, len(held[0]))
                    held, done = [], 0
                tree = t
                held = [np.concatenate(x) for x in zip(held, rows)] if held else rows
                last = len(held[0]) - width
                if last - done >= max(width, 16 * block):
                    yield nearest(*held, done, last)
                    cut = max(0, last - width)
                    held, done = [x[cut:] for x in held], last - cut
        if held:
            yield nearest(*held, done, len(held[0]))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for i, others, scores in zip(*(c.to_pylist() for c in batch.columns)):
                o, s = np.frombuffer(b"".join(others), np.int64), np.frombuffer(b"".join(scores), np.float32)
                o, s = o[s > -2], s[s > -2]
                o, where = np.unique(o, return_index=True)
                best = o[np.argsort(-s[where], kind="stable")[:keep]]
                left.append(np.minimum(best, i))
                right.append(np.maximum(best, i))
            if left:
                yield pa.record_batch([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    if partitions is None:  # few ends of partitions, as no task sees beyond its own
        most = max(trees, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        partitions = min(most, max(8, n * trees // (20 * width)))
    found = _planted(reps, trees, partitions).mapInArrow(scan, "id bigint, others binary, scores binary")
    packed = found.select("id", F.struct("others", "scores").alias("x")).groupBy("id").agg(F.collect_list("x").alias("x"))
    return packed.select("id", "x.others", "x.scores").mapInArrow(merge, "a bigint, b bigint").distinct()


def nearest_neighbours(vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", **forest) -> DataFrame:
    """(vec_id, neighbours, cosines): one row for every usable vector that is not alone, its ``k`` most similar
    of the forest in order, without any bar; copies are neighbours like others."""
    units = usable_vectors(vectors, id_col, vec_col)
    reps = representatives(units)
    pairs = exact_cosines(forest_candidates(reps, 2 * k, **forest), reps)
    links = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
    members = units.select("id", "dim", "same").distinct()
    rep = members.groupBy("dim", "same").agg(F.min("id").alias("rep"))
    first = Window.partitionBy("dim", "same").orderBy("id")
    heads = members.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k + 1).join(rep, ["dim", "same"]).select("rep", "id")
    best = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    near = links.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).select("a", F.col("b").alias("rep"), "cos")
    expanded = near.join(heads, "rep").select("a", "id", "cos").unionByName(heads.select(F.col("rep").alias("a"), "id", F.lit(1.0).alias("cos")))
    row = Window.partitionBy("a").orderBy(F.desc("cos"), "id")
    ranked = expanded.withColumn("n", F.row_number().over(row)).filter(F.col("n") <= k + 1)
    lists = ranked.groupBy(F.col("a").alias("rep")).agg(F.sort_array(F.collect_list(F.struct("n", "id", "cos"))).alias("x"))
    # a member that is not in its class's list sees the first k of it
    own = members.join(rep, ["dim", "same"]).select(F.col("id").alias("vec_id"), "rep").join(lists, "rep")
    own = own.select("vec_id", F.slice(F.filter("x", lambda e: e["id"] != F.col("vec_id")), 1, k).alias("x"))
    return own.filter(F.size("x") > 0).select("vec_id", F.col("x.id").alias("neighbours"), F.col("x.cos").alias("cosines"))


def mutual_of(lists: DataFrame) -> DataFrame:
    """(vec_lo, vec_hi) of ``nearest_neighbours``: pairs that stand in each other's list."""
    each = lists.select("vec_id", F.explode("neighbours").alias("other"))
    both = each.select(F.least("vec_id", "other").alias("vec_lo"), F.greatest("vec_id", "other").alias("vec_hi"))
    return both.groupBy("vec_lo", "vec_hi").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").drop("n")
