"""Evaluation texts leaking into training text (problem 6).

The test items form an inverted index with BM25 impacts. Every passage of every document is a query
to it, answered by block-max WAND. An item's impacts are divided by the least score that any of its
windows of ``min_run`` words has, so one threshold, 1, serves all items: a passage holding such a
window scores at least 1, and nothing is lost by the cut. Items that are retrieved are then compared
word by word.

Passages overlap by ``min_run - 1`` words, so that each run lies wholly within one. Two conditions, which lose nothing, spare
most passages the query: a run consists of words that items have, so passages are cut from the runs of such words
that are long enough; and every window of an item has a rarest word, so a passage is compared only with the items whose
rarest words it has.

Items of up to ``INDEX_CHARS`` characters in all form one index that every task holds. More than that are not collected: windows
of items and documents meet in a join by their 128-bit hashes.

Defined results: null or wordless texts match nothing; items of fewer than ``min_run`` words match
nothing; repeated rows of documents or items do not repeat the result; documents or items with a
null id take no part. Columns beyond those named are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siftwell.session import spread

WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
MIN_RUN = 12
PASSAGE = 32
BLOCK = 16
#: Characters of item text up to which one index is held by every task.
INDEX_CHARS = 16_000_000


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits in lower case."""
    return WORD.findall(text.lower()) if text else []


class ItemIndex:
    """Inverted index over items: term -> (items, impacts, block maxima, maximum)."""

    def __init__(self, items: list[tuple[int, str]], min_run: int = MIN_RUN):
        self.min_run = min_run
        kept = [(i, w) for i, w in ((i, words(t)) for i, t in items) if len(w) >= min_run]
        self.ids = [i for i, _ in kept]
        self.vocab: dict[str, int] = {}
        texts = [[self.vocab.setdefault(x, len(self.vocab)) for x in w] for _, w in kept]
        df = Counter(t for x in texts for t in set(x))
        average = sum(map(len, texts)) / max(1, len(texts))
        postings: dict[int, list[tuple[int, float]]] = {}
        self.windows: list[set[tuple[int, ...]]] = []
        self.rarest: dict[int, list[int]] = {}  # term -> items of which it is the rarest of some window
        for d, x in enumerate(texts):
            norm = K1 * (1 - B + B * len(x) / average)
            impact = {
                t: math.log(1 + (len(texts) - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm)
                for t, f in Counter(x).items()
            }
            runs = {tuple(x[i : i + min_run]) for i in range(len(x) - min_run + 1)}
            least = min(sum(impact[t] for t in set(r)) for r in runs) * (1 - 1e-9)
            for t, s in impact.items():
                postings.setdefault(t, []).append((d, s / least))
            self.windows.append(runs)
            rank = {t: (df[t], t) for t in impact}
            for t in {min(r, key=rank.__getitem__) for r in runs}:
                self.rarest.setdefault(t, []).append(d)
        self.terms = {}
        for t, rows in postings.items():
            at, impacts = [d for d, _ in rows], [s for _, s in rows]
            ends = [at[min(i + BLOCK, len(at)) - 1] for i in range(0, len(at), BLOCK)]
            highs = [max(impacts[i : i + BLOCK]) for i in range(0, len(at), BLOCK)]
            self.terms[t] = (at, impacts, ends, highs, max(impacts))

    def retrieve(self, terms: set[int], among: list[int] | None = None) -> list[int]:
        """Places of the items (of those ``among``, in order) that score at least 1 for a passage with these terms."""
        live = [[self.terms[t][0][0], 0, self.terms[t]] for t in terms]  # item, position, posting list
        if sum(c[2][4] for c in live) < 1:
            return []
        found = []
        live.sort(key=lambda c: c[0])
        while live:
            total, p = 0.0, -1
            for p, c in enumerate(live):
                total += c[2][4]
                if total >= 1:
                    break
            if total < 1:
                break
            pivot = live[p][0]
            if among is not None:
                k = bisect_left(among, pivot)
                if k == len(among):
                    break
                if among[k] > pivot:
                    live = self._forward(live, among[k])
                    continue
            while p + 1 < len(live) and live[p + 1][0] == pivot:
                p += 1
            bound, until = 0.0, math.inf
            for c in live[: p + 1]:
                ends, highs = c[2][2], c[2][3]
                b = bisect_left(ends, pivot, c[1] // BLOCK)
                if b < len(ends):
                    bound += highs[b]
                    until = min(until, ends[b] + 1)
            if bound >= 1:
                if live[0][0] == pivot:
                    if sum(c[2][1][c[1]] for c in live[: p + 1]) >= 1:
                        found.append(pivot)
                    to = pivot + 1
                else:
                    to = pivot
            else:
                to = max(pivot + 1, until) if until < math.inf else pivot + 1
                if p + 1 < len(live):
                    to = max(pivot + 1, min(to, live[p + 1][0]))
            live = self._forward(live, to)
        return found

    @staticmethod
    def _forward(live: list[list], to: int) -> list[list]:
        """The lists at their first item from ``to`` on, in order of that."""
        for c in live:
            if c[0] >= to:
                break
            c[1] = bisect_left(c[2][0], to, c[1])
            c[0] = c[2][0][c[1]] if c[1] < len(c[2][0]) else math.inf
        return sorted((c for c in live if c[0] < math.inf), key=itemgetter(0))

    def leaked(self, text: str | None) -> set[int]:
        """Ids of the items of which ``min_run`` consecutive words stand in the text."""
        n, out = self.min_run, set()
        get = self.vocab.get
        run: list[int] = []
        for w in (*words(text), ""):
            t = get(w)
            if t is not None:
                run.append(t)
                continue
            if len(run) >= n:
                for start in range(0, len(run) - n + 1, PASSAGE - n + 1):
                    out |= self._leaked_in(run[start : start + PASSAGE])
            run = []
        return out

    def _leaked_in(self, passage: list[int]) -> set[int]:
        terms, n = set(passage), self.min_run
        among = sorted({d for t in terms & self.rarest.keys() for d in self.rarest[t]})
        if not among or not (found := self.retrieve(terms, among)):
            return set()
        grams = {tuple(passage[i : i + n]) for i in range(len(passage) - n + 1)}
        return {self.ids[d] for d in found if not grams.isdisjoint(self.windows[d])}


def joined_leaks(texts: DataFrame, items: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """The same pairs without an index: distinct windows of ``min_run`` words, by hash, of both sides."""

    def windows(df: DataFrame, id_col: str) -> DataFrame:
        kind = df.schema[id_col].dataType
        arrow = to_arrow_type(kind)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, hashes = [], []
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    w = words(text)
                    mine = {xxhash.xxh3_128_digest(" ".join(w[k : k + min_run]).encode("utf-8", "surrogatepass")) for k in range(len(w) - min_run + 1)}
                    ids += [i] * len(mine)
                    hashes += mine
                yield pa.record_batch([pa.array(ids, arrow), pa.array(hashes, pa.binary())], [id_col, "window"])

        return df.mapInArrow(cut, f"{id_col} {kind.simpleString()}, window binary")

    return windows(texts, "doc_id").join(windows(items, "item_id"), "window").select("doc_id", "item_id").distinct()


def leaked_items(documents: DataFrame, items: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, item_id): documents and the items that stand in them, whole or in part."""
    spark = documents.sparkSession
    rows = items.select("item_id", "text").dropna().distinct()
    texts = spread(documents.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL"))
    if rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] > INDEX_CHARS:
        return joined_leaks(texts, rows, min_run)
    kind = documents.schema["doc_id"].dataType, items.schema["item_id"].dataType
    doc_type, item_type = map(to_arrow_type, kind)
    index = spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in rows.sort("item_id").collect()], min_run))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for batch in batches:
            docs, hits = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for item in found.leaked(text):
                    docs.append(doc)
                    hits.append(item)
            yield pa.record_batch([pa.array(docs, doc_type), pa.array(hits, item_type)], ["doc_id", "item_id"])

    return texts.mapInArrow(search, f"doc_id {kind[0].simpleString()}, item_id {kind[1].simpleString()}").distinct()


def leak_report(documents: DataFrame, items: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """Per item of the test set: in how many documents it was found."""
    hits = leaked_items(documents, items, min_run).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"))
    return items.select("item_id", "suite").distinct().join(hits, "item_id", "left").fillna(0, ["documents"])
