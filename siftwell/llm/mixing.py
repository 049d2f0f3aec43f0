"""Mixing sources to target weights (problem 7).

Temperature mixing: the shares of a mix lie on the path ``q_i ~ s_i * (w_i / s_i) ** alpha``
between the natural token shares ``s`` (alpha 0) and the wanted weights ``w`` (alpha 1). The largest
exponent that keeps every source within its repeat cap is found by bisection, and so is the largest for each source
alone: a target can be reached if that is 1. A target entropy is met the same way with ``q_i ~ s_i ** alpha``. What
is left above a cap at alpha 0 is cut at the cap.

Sizes are the estimate ``max(1, n_chars div 4)`` unless a column ``tokens`` is given, such as ``tokenizer_tokens`` of a
vocabulary file. Documents are read once: their ids, sources and sizes are written to the checkpoint folder.

The normalised weights become rows as budgeted block permutations: a source is repeated in whole
blocks (every document once per block), and the last block takes the first documents of a hashed
order until its tokens reach the remaining budget.

Defined results: null or blank ``source`` belongs to no source but counts in the total; a null
``n_chars`` is taken as the length of ``text`` (null text: 0), and a document has at least one
token; a source without documents has cap 0; null, NaN or negative ``weight``, ``max_repeats`` or
``budget_share`` count as 0; repeated rows of (mix_id, source) collapse to the one with the largest
(weight, max_repeats, budget_share); a mix whose weights add up to 0 wants nothing, so all of its
rows are reachable. A ``doc_id`` that occurs twice is two documents with equal order keys. Columns
beyond those named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.window import Window

from siftwell.session import broadcast_if_small, ensure_checkpoint_dir

#: Rows of targets and of source totals up to which they are broadcast; beyond, the joins shuffle.
MAX_BROADCAST_ROWS = 100_000
#: Hash buckets of a block; the one that the budget cuts is ordered row by row.
BLOCK_BUCKETS = 4096
STEPS = 60
#: Exponents whose entropy one pass over the sources finds, and passes.
GRID, PASSES = 16, 8


def source_key(source: Column) -> Column:
    key = F.lower(F.trim(source))
    return F.when(F.length(key) > 0, key)


def document_tokens(n_chars: Column, text: Column) -> Column:
    chars = F.coalesce(n_chars, F.length(text).cast("bigint"), F.lit(0))
    return F.greatest(F.lit(1).cast("bigint"), F.floor(chars / 4).cast("bigint"))


def tokenizer_tokens(text: Column, path: str) -> Column:
    """Tokens of a text by a vocabulary file of the ``tokenizers`` library, for ``tokens``; null texts have none."""

    @pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        from tokenizers import Tokenizer

        found = _TOKENIZERS.get(path) or _TOKENIZERS.setdefault(path, Tokenizer.from_file(path))
        return pd.Series([len(x.ids) for x in found.encode_batch([t or "" for t in texts], add_special_tokens=False)], dtype="int64")

    return F.greatest(F.lit(1).cast("bigint"), count(text))


_TOKENIZERS: dict = {}


def sized_documents(documents: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(doc_id, source, tokens)."""
    size = document_tokens(F.col("n_chars"), F.col("text")) if tokens is None else tokens
    return documents.select("doc_id", source_key(F.col("source")).alias("source"), size.alias("tokens"))


def source_totals(documents: DataFrame, tokens: Column | None = None) -> DataFrame:
    """(source, docs, tokens); source null holds what belongs to none."""
    return _totals(sized_documents(documents, tokens))


def _totals(sized: DataFrame) -> DataFrame:
    return (
        sized.groupBy("source")
        .agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    )


def _clean(targets: DataFrame) -> DataFrame:
    number = lambda c: F.when(F.isnan(F.col(c).cast("double")) | F.col(c).isNull() | (F.col(c) < 0), 0.0).otherwise(
        F.col(c).cast("double")
    )
    rows = targets.select(
        "mix_id",
        source_key(F.col("source")).alias("source"),
        F.struct(
            number("weight").alias("weight"),
            number("max_repeats").alias("max_repeats"),
            number("budget_share").alias("budget_share"),
        ).alias("x"),
    ).filter("mix_id IS NOT NULL AND source IS NOT NULL")
    return rows.groupBy("mix_id", "source").agg(F.max("x").alias("x")).select("mix_id", "source", "x.*")


def temperature_shares(totals: DataFrame, entropy: float) -> DataFrame:
    """(source, share, alpha): ``share ~ tokens ** alpha`` with the largest alpha in [0, 1] whose
    entropy (nats) is at least ``entropy``; alpha 0 (equal shares) where none reaches it.

    Entropy falls with alpha. It follows from two sums over the sources, so each pass sums ``GRID`` exponents between the bounds
    of the pass before, and no task holds more than those sums however many sources there are."""
    rows = totals.filter("source IS NOT NULL AND tokens > 0").select("source", F.log(F.col("tokens").cast("double")).alias("size"))
    top = rows.agg(F.max("size")).first()[0] or 0.0
    size = F.col("size") - top

    def powers(exponents: list[float]) -> list[tuple[float, float]]:
        """(sum of powers, entropy) at each exponent."""
        sums = rows.agg(*(f for a in exponents for f in (F.sum(F.exp(a * size)), F.sum(a * size * F.exp(a * size))))).first()
        return [(sums[2 * i] or 1.0, float(np.log(sums[2 * i] or 1.0) - (sums[2 * i + 1] or 0.0) / (sums[2 * i] or 1.0))) for i in range(len(exponents))]

    low, high = 0.0, 1.0
    if powers([1.0])[0][1] >= entropy:
        low = 1.0
    for _ in range(PASSES if low < 1.0 else 0):
        grid = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        enough = [i for i, (_, h) in enumerate(powers(grid)) if h >= entropy]
        last = max(enough, default=0)
        low, high = grid[last], grid[min(last + 1, GRID)]
    whole = powers([low])[0][0]
    return rows.select("source", (F.exp(low * size) / whole).alias("share"), F.lit(low).alias("alpha"))


def plan_mix(documents: DataFrame, targets: DataFrame, tokens: Column | None = None) -> DataFrame:
    """One row per (mix_id, source): what is wanted, the cap, whether the target can be reached,
    the exponents of the mix and of the source, and the planned share and tokens.

    A mix has one row per source, so the rows of a mix are gathered into one for the bisection;
    documents are only summed, once."""
    return _plan(sized_documents(documents, tokens), targets)


def _plan(sized: DataFrame, targets: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(sized.sparkSession)
    by_source = _totals(sized).checkpoint()
    whole = float(by_source.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0])
    wanted = (
        _clean(targets)
        .join(by_source.filter("source IS NOT NULL"), "source", "left")
        .withColumn("tokens", F.coalesce(F.col("tokens"), F.lit(0)).cast("double"))
        .withColumn("all_tokens", F.lit(whole))
    )
    number = ["weight", "max_repeats", "budget_share", "tokens", "all_tokens"]
    return wanted.select("mix_id", "source", *number).groupBy("mix_id").applyInPandas(_solve, _plan_schema(targets))


def _plan_schema(targets: DataFrame) -> str:
    return (
        f"mix_id {targets.schema['mix_id'].dataType.simpleString()}, source string, budget double, alpha double, "
        "target_share double, source_tokens double, max_repeats double, want_tokens double, cap_tokens double, "
        "source_alpha double, reachable boolean, planned_share double, planned_tokens double"
    )


def _solve(rows: pd.DataFrame) -> pd.DataFrame:
    """The plan of one mix."""
    rows = rows.sort_values("source", ignore_index=True)
    total, tokens = rows.weight.sum(), rows.tokens.to_numpy()
    w = (rows.weight / total if total > 0 else rows.weight * 0).to_numpy()
    s = tokens / tokens.sum() if tokens.sum() > 0 else tokens * 0
    want, cap = w * rows.budget_share * rows.all_tokens, tokens * rows.max_repeats
    budget, live = want.sum(), (w > 0) & (s > 0)

    def at(alpha: float, among: np.ndarray) -> np.ndarray:
        q = np.where(among, s ** (1 - alpha) * w**alpha, 0.0)  # 0 ** 0 is 1: at 1 a source without documents is still wanted
        return q / q.sum() if q.sum() > 0 else q

    alpha = bisect_exponent(lambda a: bool((at(a, live) * budget <= cap * (1 + 1e-9)).all()))
    q = at(alpha, live)
    own = np.array([bisect_exponent(lambda a, i=i: at(a, w > 0)[i] * budget <= cap[i] * (1 + 1e-12)) for i in range(len(w))])
    out = pd.DataFrame({"mix_id": rows.mix_id, "source": rows.source, "budget": budget, "alpha": alpha})
    out = out.assign(target_share=w, source_tokens=tokens, max_repeats=rows.max_repeats, want_tokens=want, cap_tokens=cap)
    return out.assign(source_alpha=own, reachable=own == 1.0, planned_share=q, planned_tokens=np.minimum(q * budget, cap))


def bisect_exponent(ok: Callable[[float], bool]) -> float:
    """The largest exponent in [0, 1] for which ``ok`` holds, given that it holds below it; 0 if nowhere."""
    if ok(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(STEPS):
        mid = (low + high) / 2
        low, high = (mid, high) if ok(mid) else (low, mid)
    return low


def sample_mix(documents: DataFrame, targets: DataFrame, seed: int = 0, tokens: Column | None = None) -> DataFrame:
    """The chosen rows: (mix_id, source, doc_id, tokens, block, order_key).

    ``block`` numbers the passes over the source from 0; ``order_key`` orders the documents of a
    block. The cut block is found from sums over hash buckets, so that no task ever holds more of a
    source than one bucket; the document on whose middle the budget falls is left out."""
    ensure_checkpoint_dir(documents.sparkSession)
    sized = sized_documents(documents, tokens).checkpoint()
    return _sample(sized, _plan(sized, targets), seed)


def _sample(sized: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    plan = plan.filter("planned_tokens > 0 AND source_tokens > 0").select(
        "mix_id",
        "source",
        F.floor(F.col("planned_tokens") / F.col("source_tokens") + 1e-9).cast("int").alias("full"),
        F.col("planned_tokens").alias("planned"),
        "source_tokens",
    ).withColumn("rest", F.greatest(F.lit(0.0), F.col("planned") - F.col("full") * F.col("source_tokens")))
    plan = plan.drop("planned", "source_tokens").checkpoint()
    docs = sized.filter("source IS NOT NULL")
    rows = docs.join(broadcast_if_small(plan, MAX_BROADCAST_ROWS), "source")
    key = F.xxhash64(F.lit(seed), "mix_id", "source", "full", "doc_id")
    rows = rows.withColumn("order_key", key).withColumn("bucket", F.pmod("order_key", F.lit(BLOCK_BUCKETS)).cast("int"))
    sums = rows.filter("rest > 0").groupBy("mix_id", "source", "bucket").agg(
        F.sum("tokens").alias("bucket_tokens"), F.first("rest").alias("cut")
    )
    run = Window.partitionBy("mix_id", "source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.withColumn("before", F.coalesce(F.sum("bucket_tokens").over(run), F.lit(0))).select(
        "mix_id", "source", "bucket", "before", (F.col("before") + F.col("bucket_tokens") <= F.col("cut")).alias("whole")
    ).filter(F.col("before") < F.col("cut")).checkpoint()  # at most BLOCK_BUCKETS rows a source and mix
    placed = rows.join(broadcast_if_small(ahead, MAX_BROADCAST_ROWS), ["mix_id", "source", "bucket"], "left")
    inside = Window.partitionBy("mix_id", "source").orderBy("order_key", "doc_id")
    cut = (
        placed.filter("NOT whole")
        .withColumn("upto", F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("before") + F.col("upto") - F.col("tokens") / 2 < F.col("rest"))
    )
    columns = ["mix_id", "source", "doc_id", "tokens"]
    partial = placed.filter("whole").select(*columns, F.col("full").alias("block"), "order_key").unionByName(
        cut.select(*columns, F.col("full").alias("block"), "order_key")
    )
    full = rows.filter("full > 0").select(
        *columns, F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("block")
    ).withColumn("order_key", F.xxhash64(F.lit(seed), "mix_id", "source", "block", "doc_id"))
    return full.unionByName(partial)


def mix_report(documents: DataFrame, targets: DataFrame, seed: int = 0, tokens: Column | None = None) -> DataFrame:
    """The shares reached: one row per (mix_id, source) of the targets."""
    ensure_checkpoint_dir(documents.sparkSession)
    sized = sized_documents(documents, tokens).checkpoint()
    plan = _plan(sized, targets).checkpoint()
    chosen = (
        _sample(sized, plan, seed)
        .groupBy("mix_id", "source")
        .agg(F.sum("tokens").alias("chosen_tokens"), F.count(F.lit(1)).alias("chosen_rows"))
    )
    whole = Window.partitionBy("mix_id")
    rows = plan.join(chosen, ["mix_id", "source"], "left").fillna(0, ["chosen_tokens", "chosen_rows"])
    reached = F.try_divide(F.col("chosen_tokens"), F.sum("chosen_tokens").over(whole))
    return rows.withColumn("reached_share", F.coalesce(reached, F.lit(0.0))).withColumn(
        "repeats", F.when(F.col("source_tokens") > 0, F.col("chosen_tokens") / F.col("source_tokens")).otherwise(0.0)
    )
