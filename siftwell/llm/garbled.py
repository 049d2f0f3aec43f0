"""Garbled text from wrong character encoding (problem 8).

A chain says how a text may have gone wrong: written as encoding ``true``, read as ``wrong``, or up to three such steps, of
the same or of different encodings, where each reads UTF-8. Undoing a chain turns a garbled token back into text; a model of character pairs, counted over
the non-ASCII tokens of all documents, says how much likelier that text is than the token as it stands.

Each text has one latent chain (or none). Expectation-maximization pools the evidence of all records of a source and
field: priors per source, field and chain are re-estimated from the posteriors until they stand still, so that weak evidence in
one record counts where its source is known for the fault. A document is a case where the posterior of
"no chain" is below one half; it is repaired token by token with its likeliest chain. Replacement
characters are evidence of a reading that lost bytes; they cannot be restored.

Passages between single backquotes are examples and are neither judged nor repaired.

Defined results: null, empty and pure ASCII texts are clean; rows with a null doc_id take no part; a
doc_id with several texts is judged by each row; sources are compared trimmed and in lower case, null as
blank.
"""

from __future__ import annotations

import atexit
import codecs
import math
import os
import re
import shutil
import tempfile
from collections import Counter
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siftwell.session import ensure_checkpoint_dir, spread

# Single-byte encodings by which text is read wrongly, and encodings in which it was written.
WRONG = "cp1252 latin-1 cp1250 iso8859-2 cp1251 koi8-r cp866 iso8859-5 cp437 cp850 cp852 mac-roman cp1253 iso8859-7 cp1254 iso8859-15 cp1257".split()
WRONG_WIDE = "gb18030 cp932 big5 euc-jp euc-kr".split()
TRUE = "utf-8 cp1252 cp1250 iso8859-2 cp1251 koi8-r cp866 iso8859-5 cp437 cp850 cp852 mac-roman cp1253 cp932 euc-jp gb18030 big5 euc-kr".split()
WIDE = frozenset("cp932 euc-jp gb18030 big5 euc-kr".split())
#: Steps of a chain. Further steps are tried behind one that gave valid UTF-8, which garbled text alone does.
STEPS = 3
LOSSY = "lossy"
CLEAN = "clean"

#: Share of a damaged document's tokens that are damaged, at the start of every document's score.
PART = 0.5
#: Prior odds against any one chain before a source is known, and documents' worth of it that stay in.
PRIOR = 1e-4
SMOOTHING = 2.0
#: Rounds at most, and the change of every prior at which they end.
ROUNDS = 12
STILL = 1e-3
#: Sources and fields whose priors are held by every task; where there are more, priors are joined.
MAX_SOURCES = 1000
#: Chains with less evidence than this (in nats) are not carried.
LEAST = 0.5
LOSSY_GAIN = 12.0
#: Nats against a chain for each token of a line that it cannot be undone on.
FAILS = -4.0

_TOKEN = re.compile(r"[^ \t\r\n]*[^\x00-\x7f][^ \t\r\n]*")
_QUOTED = re.compile(r"(?<!`)`[^`\n]+`(?!`)")
_FENCES = re.compile(r"```")


def tokens_of(text: str) -> list[str]:
    """Tokens with a character beyond ASCII, without what stands between single backquotes."""
    if text.isascii():
        return []
    return _TOKEN.findall(_QUOTED.sub(" ", text))


def symbol(c: str) -> str:
    """The symbol that the model counts: Han, Hangul and rare planes as blocks of 16, the rest itself."""
    o = ord(c)
    if o < 0x80:
        return c.lower() if c.isalpha() else "0" if c.isdigit() else c
    if o < 0x2E80 or 0x3000 <= o < 0x3400 or 0xFF00 <= o:
        return c if o < 0x10000 else "\U0001f000"
    return chr(o & ~15)


def pairs_of(token: str) -> Iterator[tuple[str, str]]:
    s = [" ", *map(symbol, token), " "]
    return zip(s, s[1:])


class PairFile:
    """Counts of pairs in a file that tasks map: all keys in order, then their counts."""

    def __init__(self, name: str, size: int):
        self.name, self.size = name, size

    @cached_property
    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        both = np.memmap(SparkFiles.get(self.name), np.int64, "r", shape=(2, self.size))
        return both[0], both[1]

    def __getstate__(self) -> dict:
        return {"name": self.name, "size": self.size}

    def get(self, pair: tuple[str, str], default: int = 0) -> int:
        keys, counts = self._tables
        key = np.int64(ord(pair[0]) << 21 | ord(pair[1]))
        i = int(keys.searchsorted(key))
        return int(counts[i]) if i < self.size and keys[i] == key else default


class PairModel:
    """Interpolated character-pair model. ``left`` and ``right``: how often a symbol begins and ends a pair."""

    def __init__(self, pairs: dict[tuple[str, str], int] | PairFile, left: Counter[str] | None = None, right: Counter[str] | None = None):
        self.pairs = pairs
        self.left: Counter[str] = left or Counter()
        self.right: Counter[str] = right or Counter()
        if left is None:
            for (a, b), n in pairs.items():
                self.left[a] += n
                self.right[b] += n
        self.total = sum(self.right.values())
        self.cache: dict[tuple[str, str], float] = {}
        self.symbols: dict[str, str] = {}

    def cost(self, token: str) -> float:
        """Minus the log-likelihood of a token."""
        symbols, cache, out, a = self.symbols, self.cache, 0.0, " "
        for c in (*token, " "):
            b = symbols.get(c)
            if b is None:
                b = symbols[c] = symbol(c)
            x = cache.get((a, b))
            if x is None:
                if len(cache) > MAX_PAIRS:
                    cache.clear()
                base = (self.right[b] + 0.2) / (self.total + 20_000)
                x = cache[a, b] = -math.log((self.pairs.get((a, b), 0) + 8 * base) / (self.left[a] + 8))
            out += x
            a = b
        return out


@lru_cache(None)
def _table(encoding: str) -> dict:
    """A character map back to bytes; bytes without a character stand as control characters."""
    chars = []
    for i in range(256):
        try:
            chars.append(bytes([i]).decode(encoding))
        except UnicodeDecodeError:
            chars.append(chr(i))
    return codecs.charmap_build("".join(chars))


def _back(text: str, wrong: str) -> bytes | None:
    try:
        if wrong in WRONG_WIDE:
            return text.encode(wrong)
        return codecs.charmap_encode(text, "strict", _table(wrong))[0]
    except UnicodeError:
        return None


def _read(raw: bytes, true: str) -> str | None:
    try:
        return raw.decode(true)
    except UnicodeError:
        return None


def chains_of(token: str) -> list[tuple[str, str]]:
    """(chain, text) of every chain that can be undone on the token."""
    out = []
    reads: dict[tuple[bytes, str], str | None] = {}  # encodings that agree on the token give the same bytes
    for wrong in (*WRONG, *WRONG_WIDE):
        raw = _back(token, wrong)
        if raw is None or raw.isascii() and not token.isascii() and wrong not in WRONG_WIDE:
            continue
        wide = wrong in WRONG_WIDE
        for true in TRUE:
            if true == wrong or wide and true != "utf-8" and true not in WIDE:
                continue
            if (raw, true) in reads:
                text = reads[raw, true]
            else:
                text = _read(raw, true)
                text = reads[raw, true] = None if text is None or "�" in text else text
            if text is None:
                continue
            name = f"{true}>{wrong}"
            out.append((name, text))
            if true == "utf-8" and text != token:
                _further([name], text, out)
    return out


def _further(steps: list[str], text: str, out: list[tuple[str, str]]) -> None:
    """Adds the chains that go on behind ``steps``, which gave ``text``."""
    if len(steps) == STEPS or text.isascii():
        return
    for wrong in WRONG:
        raw = _back(text, wrong)
        again = _read(raw, "utf-8") if raw is not None and not raw.isascii() else None
        if again and again != text and "�" not in again:
            out.append(("+".join(more := [*steps, f"utf-8>{wrong}"]), again))
            _further(more, again, out)


def undo(token: str, chain: str) -> str | None:
    for step in chain.split("+"):
        true, wrong = step.split(">")
        raw = _back(token, wrong)
        token = raw is not None and _read(raw, true)
        if not token:
            return None
    return token


class Judge:
    """Evidence of each chain in a text."""

    def __init__(self, model: PairModel):
        self.model = model
        self.gains = lru_cache(100_000)(self._gains)

    def _gains(self, token: str) -> tuple[dict[str, float], frozenset[str]]:
        """Chain -> nats by which the undone token is likelier (0 where it stays the same), and the chains by which it is."""
        own = self.model.cost(token)
        found = chains_of(token)
        gain = {text: own - self.model.cost(text) if text != token else 0.0 for text in {text for _, text in found}}
        gains = {chain: gain[text] for chain, text in found}
        return gains, frozenset(c for c, x in gains.items() if x > 0)

    def evidence(self, text: str) -> list[tuple[str, float]]:
        """(chain, log-likelihood ratio against none).

        A line is read by a chain as a whole or not at all; where the chain ends in UTF-8, whose faults show on each
        token, tokens on which it fails stand as they are. Equal lines count once."""
        if text.isascii():
            return []
        total: dict[str, float] = {}
        lines = {m: None for x in _QUOTED.sub(" ", text).split("\n") if not x.isascii() and (m := tuple(_TOKEN.findall(x)))}
        seen: set[str] = set()
        for tokens in lines:
            gains, better = zip(*(self.gains(t) for t in tokens))
            for t in tokens:
                if "�" in t and t not in seen:
                    seen.add(t)
                    total[LOSSY] = total.get(LOSSY, 0.0) + LOSSY_GAIN
            for chain in frozenset().union(*better):
                if chain.startswith("utf-8"):
                    gain = sum(max(g.get(chain, 0.0), 0.0) for g in gains)
                else:
                    gain = sum(g.get(chain, FAILS) for g in gains)
                if gain > FAILS:
                    total[chain] = total.get(chain, 0.0) + math.log(1 - PART + PART * math.exp(min(gain, 300.0))) - math.log(1 - PART)
        # the share of damaged lines is unknown: a cost that does not grow with the text
        return sorted((c, x + math.log(1 - PART)) for c, x in total.items() if x + math.log(1 - PART) > LEAST)

    def repair(self, text: str, chain: str) -> str:
        if chain == LOSSY:
            return text
        kept: list[str] = []
        at = 0
        for m in [*_QUOTED.finditer(text), None]:
            stop = m.start() if m else len(text)
            kept.append(_TOKEN.sub(lambda t: self._one(t.group(), chain), text[at:stop]))
            if m:
                kept.append(m.group())
                at = m.end()
        return "".join(kept)

    def _one(self, token: str, chain: str) -> str:
        back = undo(token, chain)
        return back if back and self.model.cost(back) < self.model.cost(token) else token


def count_pairs(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """(a, b, n): symbol pairs of the non-ASCII tokens of all texts. Symbols are bounded by the model's alphabet."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str]] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for token in tokens_of(text):
                    seen.update(pairs_of(token))
            if len(seen) > 200_000:
                yield _pair_batch(seen)
                seen.clear()
        if seen:
            yield _pair_batch(seen)

    texts = documents.select(text_col).filter(F.col(text_col).isNotNull())
    parts = spread(texts).mapInArrow(count, "a string, b string, n bigint")
    return parts.groupBy("a", "b").agg(F.sum("n").alias("n"))


def _pair_batch(seen: Counter) -> pa.RecordBatch:
    a, b = zip(*seen) if seen else ((), ())
    return pa.record_batch([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(list(seen.values()), pa.int64())], ["a", "b", "n"])


#: Pairs that every task holds; where there are more, the model is a file that tasks map.
MAX_PAIRS = 400_000


def _model(documents: DataFrame) -> PairModel:
    """The model of all pairs of the documents."""
    pairs = count_pairs(documents)
    rows = pairs.limit(MAX_PAIRS + 1).collect()
    return PairModel({(r.a, r.b): r.n for r in rows}) if len(rows) <= MAX_PAIRS else _filed(pairs)


def _filed(pairs: DataFrame) -> PairModel:
    """The model in a file, written as the sorted pairs arrive, one partition at a time."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n = (c.to_pylist() for c in batch.columns)
            keys = np.array([ord(x) << 21 | ord(y) for x, y in zip(a, b)], np.int64)
            yield pa.record_batch([pa.array([keys.tobytes()]), pa.array([np.array(n, np.int64).tobytes()])], ["keys", "counts"])

    left: Counter[str] = Counter()
    right: Counter[str] = Counter()
    size = 0
    folder = tempfile.mkdtemp(prefix="pairs-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors fetch it when they first need it
    name = os.path.basename(folder)
    path = os.path.join(folder, name)
    with open(path, "wb") as out, tempfile.TemporaryFile(dir=folder) as behind:
        # strings are ordered by code point, as keys are
        for r in pairs.orderBy("a", "b").mapInArrow(pack, "keys binary, counts binary").toLocalIterator():
            keys, counts = np.frombuffer(r.keys, np.int64), np.frombuffer(r.counts, np.int64)
            for side, symbols in ((left, keys >> 21), (right, keys & (1 << 21) - 1)):
                found, at = np.unique(symbols, return_inverse=True)
                sums = np.zeros(len(found), np.int64)
                np.add.at(sums, at, counts)
                side.update(dict(zip(map(chr, found.tolist()), sums.tolist())))
            out.write(r.keys)
            behind.write(r.counts)
            size += len(keys)
        behind.seek(0)
        shutil.copyfileobj(behind, out)
    pairs.sparkSession.sparkContext.addFile(path)
    return PairModel(PairFile(name, size), left, right)


def _field(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(doc_id, field, text, source): a row per text of a document; ``source`` is what evidence is pooled by, with the field."""
    source = F.coalesce(F.lower(F.trim("source")), F.lit("")) if "source" in df.columns else F.lit("")
    texts = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields)))
    rows = df.select("doc_id", source.alias("source"), texts.alias("t")).select("doc_id", "t.field", "t.text", "source")
    return rows.withColumn("source", F.concat_ws("\1", "source", "field")).filter("doc_id IS NOT NULL AND text IS NOT NULL")


def fitted(documents: DataFrame, fields: tuple[str, ...] = ("text",)):
    """The pair model of the documents, held by every task."""
    return documents.sparkSession.sparkContext.broadcast(_model(_field(documents, fields)))


def judged(documents: DataFrame, fields: tuple[str, ...] = ("text",), judge=None) -> DataFrame:
    """(doc_id, field, source, row, chain, posterior, clean): texts with evidence of some chain, each with its likeliest
    one; ``clean`` is the posterior of none, ``row`` a hash of the text."""
    spark = documents.sparkSession
    ensure_checkpoint_dir(spark)
    docs = _field(documents, fields)
    judge = judge or fitted(documents, fields)
    doc_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = Judge(judge.value)
        for batch in batches:
            ids, names, rows, sources, chains, nats = [], [], [], [], [], []
            for doc, field, text, source, row in zip(*(c.to_pylist() for c in batch.columns)):
                found = j.evidence(text)
                if found:
                    ids.append(doc)
                    names.append(field)
                    rows.append(row)
                    sources.append(source)
                    chains.append([c for c, _ in found])
                    nats.append([x for _, x in found])
            yield pa.record_batch(
                [pa.array(ids, doc_type), pa.array(names, pa.string()), pa.array(rows, pa.int64()), pa.array(sources, pa.string()), pa.array(chains, pa.list_(pa.string())), pa.array(nats, pa.list_(pa.float64()))],
                ["doc_id", "field", "row", "source", "chains", "nats"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    weighed = (
        spread(docs)
        .withColumn("row", F.xxhash64("text"))
        .mapInArrow(weigh, f"doc_id {kind}, field string, row bigint, source string, chains array<string>, nats array<double>")
        .checkpoint()
    )
    whole = max(1, docs.count())
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r.source: r.n for r in counts.limit(MAX_SOURCES + 1).collect()}
    priors = _held_priors(spark, weighed, sizes, whole) if len(sizes) <= MAX_SOURCES else _joined_priors(weighed, counts.checkpoint(), whole)
    best = F.max_by(F.struct("chain", "posterior"), F.struct("posterior", "chain"))
    return (
        _scored(weighed, *priors)
        .groupBy("doc_id", "field", "row", "source")
        .agg(best.alias("b"), F.greatest(F.lit(0.0), 1 - F.sum("posterior")).alias("clean"))
        .select("doc_id", "field", F.split_part("source", F.lit("\1"), F.lit(1)).alias("source"), "row", "b.chain", "b.posterior", "clean")
    )


def _shares(odds: Column) -> Column:
    """(chain, posterior) from the odds against none."""
    total = F.aggregate(odds, F.lit(1.0), lambda a, x: a + x)
    return F.transform(
        F.arrays_zip("chains", F.transform(odds, lambda x: x / total).alias("p")),
        lambda z: F.struct(z["chains"].alias("chain"), z["p"].alias("posterior")),
    )


def _scored(weighed: DataFrame, own: DataFrame, everywhere: dict[str, float]) -> DataFrame:
    """Posterior of each chain of each document by ``own`` (source, prior), else by the priors of all documents."""
    fallback = F.create_map(*(F.lit(x) for cp in sorted(everywhere.items()) for x in cp)).cast("map<string,double>")
    odds = F.transform(
        F.arrays_zip("chains", "nats"),
        lambda z: F.exp(F.least(z["nats"], F.lit(300.0)))
        * F.coalesce(F.try_element_at("prior", z["chains"]), F.try_element_at(fallback, z["chains"]), F.lit(PRIOR)),
    )
    return weighed.join(own, "source", "left").withColumn("odds", odds).select("doc_id", "field", "row", "source", F.inline(_shares(F.col("odds"))))


def _everywhere(overall: dict[str, float], whole: int) -> dict[str, float]:
    return {c: (x + SMOOTHING * PRIOR) / (whole + SMOOTHING) for c, x in overall.items()}


def _held_priors(spark, weighed: DataFrame, sizes: dict[str, int], whole: int) -> tuple[DataFrame, dict[str, float]]:
    """Priors (source, prior) that stand still, and those of all documents; at most sources times chains, both bounded here."""
    priors: dict[tuple[str, str], float] = {}

    def tables() -> tuple[DataFrame, dict[str, float]]:
        own: dict[str, dict[str, float]] = {}
        for (s, c), p in priors.items():
            own.setdefault(s, {})[c] = p
        everywhere = own.pop("*", {})
        return F.broadcast(spark.createDataFrame(sorted(own.items()), "source string, prior map<string,double>")), everywhere

    for _ in range(ROUNDS):
        sums = _scored(weighed, *tables()).groupBy("source", "chain").agg(F.sum("posterior").alias("p")).collect()
        overall: Counter[str] = Counter()
        for r in sums:
            overall[r.chain] += r.p
        everywhere = _everywhere(overall, whole)
        before, priors = priors, {
            (r.source, r.chain): (r.p + SMOOTHING * max(PRIOR, everywhere[r.chain])) / (sizes[r.source] + SMOOTHING) for r in sums
        } | {("*", c): max(PRIOR, x) for c, x in everywhere.items()}
        if all(abs(p - before.get(k, PRIOR)) < STILL for k, p in priors.items()):
            break
    return tables()


def _joined_priors(weighed: DataFrame, sizes: DataFrame, whole: int) -> tuple[DataFrame, dict[str, float]]:
    """The same priors for any number of sources: a row per source and chain, joined; only those of all documents are collected."""
    priors = weighed.sparkSession.createDataFrame([], "source string, chain string, p double")
    everywhere: dict[str, float] = {}

    def own() -> DataFrame:
        return priors.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("chain", "p"))).alias("prior"))

    for _ in range(ROUNDS):
        sums = _scored(weighed, own(), everywhere).groupBy("source", "chain").agg(F.sum("posterior").alias("s")).checkpoint()
        overall = {r.chain: r.s for r in sums.groupBy("chain").agg(F.sum("s").alias("s")).collect()}
        known, everywhere = everywhere, {c: max(PRIOR, x) for c, x in _everywhere(overall, whole).items()}
        if not everywhere:
            break
        usual = F.create_map(*(F.lit(x) for cp in sorted(everywhere.items()) for x in cp))[F.col("chain")]
        moved = F.abs(F.col("p") - F.coalesce("q", F.lit(PRIOR)))
        after = sums.join(sizes, "source").select("source", "chain", ((F.col("s") + SMOOTHING * usual) / (F.col("n") + SMOOTHING)).alias("p")).checkpoint()
        change = after.join(priors.withColumnRenamed("p", "q"), ["source", "chain"], "left").agg(F.max(moved)).first()[0]
        priors = after
        if change < STILL and all(abs(p - known.get(c, PRIOR)) < STILL for c, p in everywhere.items()):
            break
    return own(), everywhere


def garbled_documents(documents: DataFrame, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(doc_id, field, chain, posterior) of the texts that were read with a wrong encoding."""
    return judged(documents, fields).filter("clean < 0.5").select("doc_id", "field", "chain", F.round(1 - F.col("clean"), 6).alias("posterior"))


def repaired_documents(documents: DataFrame, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(doc_id, field, chain, restorable, repaired) of the garbled texts; the pair model is fitted once."""
    docs, judge = _field(documents, fields), fitted(documents, fields)
    cases = judged(documents, fields, judge).filter("clean < 0.5").select("doc_id", "field", "row", "chain")
    doc_type = to_arrow_type(docs.schema["doc_id"].dataType)

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        j = Judge(judge.value)
        for batch in batches:
            ids, names, chains, texts = (c.to_pylist() for c in batch.columns)
            out = [j.repair(t, c) for t, c in zip(texts, chains)]
            whole = ["�" not in _QUOTED.sub(" ", t) and c != LOSSY for t, c in zip(out, chains)]
            columns = [pa.array(ids, doc_type), pa.array(names, pa.string()), pa.array(chains, pa.string()), pa.array(whole, pa.bool_()), pa.array(out, pa.string())]
            yield pa.record_batch(columns, ["doc_id", "field", "chain", "restorable", "repaired"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    hit = docs.withColumn("row", F.xxhash64("text")).join(cases, ["doc_id", "field", "row"]).select("doc_id", "field", "chain", "text")
    return hit.mapInArrow(mend, f"doc_id {kind}, field string, chain string, restorable boolean, repaired string")
