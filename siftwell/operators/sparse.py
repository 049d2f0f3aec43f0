"""Lexical retrieval: an inverted index, BM25 with phrases, and path and content matches.

Terms are runs of letters and digits in lower case with diacritics folded; a query token with ``_`` in it is a
phrase. Scores follow the usual full-text formula and are negative, smaller being better:
``-sum(idf * f * (k1 + 1) / (f + k1 * (1 - b + b * len / avg)))`` with ``idf = ln((n - df + 0.5) / (df + 0.5))``, at least
1e-6. A match of a term in path or content scores ``-1000 - (3 per path, 1 per content)``, so such
matches come before those by BM25 alone.

Null contents have no terms; ties rank by id.
"""

from __future__ import annotations

import math
import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.functions.text import path_terms, query_tokens
from siftwell.operators.paths import lexical_path_predicate
from siftwell.session import spread

K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
LEXICAL_BASE = -1000.0
WORD = r"[\p{L}\p{N}]+"


def _folds() -> tuple[str, str]:
    """Letters with diacritics and their bases, by Unicode decomposition."""
    pairs = {}
    for o in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        c = chr(o)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if len(base) == 1 and base != c:
            pairs[c] = base
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _folds()


def fold_col(text: Column) -> Column:
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, FOLD_FROM, FOLD_TO)).otherwise(text)


def fold(text: str) -> str:
    return text.translate(str.maketrans(FOLD_FROM, FOLD_TO))


def terms_col(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(fold_col(text)), F.lit(f"({WORD})"), 1)


def terms_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", fold(text).lower())


def build_postings(docs: DataFrame, id_col: str = "chunk_id", text_col: str = "content", group: str | None = "workspace_id") -> DataFrame:
    """(workspace_id, term, chunk_id, tf, doc_len, positions): one row per term of a document."""
    space = F.col(group) if group else F.lit(None).cast("string")
    words = docs.select(space.alias("workspace_id"), F.col(id_col).cast("string").alias("chunk_id"), terms_col(F.col(text_col)).alias("w")).dropDuplicates(
        ["workspace_id", "chunk_id"]
    )
    each = words.select("workspace_id", "chunk_id", F.size("w").alias("doc_len"), F.posexplode("w").alias("pos", "term"))
    return each.groupBy("workspace_id", "term", "chunk_id").agg(
        F.count(F.lit(1)).cast("int").alias("tf"),
        F.first("doc_len").alias("doc_len"),
        F.sort_array(F.collect_list("pos")).alias("positions"),
    ).select("workspace_id", "term", "chunk_id", "tf", "doc_len", "positions")


def term_stats(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, df, cf): documents and occurrences of each term."""
    words = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("id"), F.explode(terms_col(F.col(text_col))).alias("term"))
    per_doc = words.groupBy("term", "id").agg(F.count(F.lit(1)).alias("tf"))
    return per_doc.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def corpus_stats(docs: DataFrame, text_col: str) -> DataFrame:
    """(n_docs, total_len, avg_len), one row."""
    return spread(docs.select(text_col)).select(F.size(terms_col(F.col(text_col))).alias("n")).agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.coalesce(F.sum(F.greatest("n", F.lit(0))), F.lit(0)).alias("total_len"),
        F.coalesce(F.avg(F.greatest("n", F.lit(0))), F.lit(0.0)).alias("avg_len"),
    )


def _spaced(words: list[str]) -> str:
    return " " + "  ".join(words) + " "


def _phrase_count(spaced: Column, phrase: list[str]) -> Column:
    """How often the phrase stands in a text of terms, each between two blanks of its own."""
    wanted = _spaced(phrase)
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(wanted), F.lit("")))) / len(wanted)).cast("int")


def bm25(docs: DataFrame, tokens: list[str], id_col: str, text_col: str, where: Column | None = None) -> DataFrame:
    """``docs`` that hold one of the tokens, with ``bm25_score``. Statistics are over all documents, ``where`` filters matches.

    The query is small, so the text is scanned once for the frequencies of its phrases: one aggregate of one
    row gives the statistics, and no postings are shuffled. See ``bm25_from_postings`` for an index."""
    phrases = [p for t in tokens if (p := terms_of(t))]
    if not phrases:
        return docs.withColumn("bm25_score", F.lit(0.0)).filter(F.lit(False))
    # the terms are bound as a lambda's variable and exploded: as plain columns the optimizer would inline the
    # expression that splits the text into every use
    spaced = F.transform(
        F.array(F.coalesce(terms_col(F.col(text_col)), F.array().cast("array<string>"))),
        lambda w: F.struct(F.size(w).alias("len"), F.concat(F.lit(" "), F.array_join(w, "  "), F.lit(" ")).alias("text")),
    )
    rows = docs.withColumn("__t", F.explode(spaced))
    counted = rows.select(
        *docs.columns, F.col("__t.len").alias("__len"), *(_phrase_count(F.col("__t.text"), p).alias(f"__f{i}") for i, p in enumerate(phrases))
    )
    stats = counted.agg(
        F.count(F.lit(1)).alias("n"), F.avg("__len").alias("avg"), *(F.count(F.when(F.col(f"__f{i}") > 0, 1)).alias(f"df{i}") for i in range(len(phrases)))
    ).first()
    score = F.lit(0.0)
    for i in range(len(phrases)):
        if stats[f"df{i}"]:
            score = score + _weight(_idf(stats["n"], stats[f"df{i}"]), F.col(f"__f{i}"), F.col("__len"), stats["avg"] or 1.0)
    any_hit = F.greatest(*(F.col(f"__f{i}") for i in range(len(phrases))), F.lit(0)) > 0
    hit = counted.filter(any_hit if where is None else any_hit & where)
    return hit.select(*docs.columns, (-score).alias("bm25_score"))


def _idf(n: int, df: int) -> float:
    return max(LEAST_IDF, math.log((n - df + 0.5) / (df + 0.5)))


def _weight(idf: float, f: Column, length: Column, average: float) -> Column:
    return F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / average))).otherwise(0.0)


def bm25_from_postings(postings: DataFrame, tokens: list[str], workspace: str | None = None) -> DataFrame:
    """(chunk_id, bm25_score) from an index. Only rows of the query's terms are read; statistics of the corpus come
    from the sum of frequencies, phrases from positions."""
    phrases = [p for t in tokens if (p := terms_of(t))]
    mine = postings if workspace is None else postings.filter(F.col("workspace_id") == workspace)
    docs = mine.select("chunk_id", "doc_len").distinct()
    n, average = docs.agg(F.count(F.lit(1)), F.avg("doc_len")).first()
    if not phrases or not n:
        return postings.select("chunk_id", F.lit(0.0).alias("bm25_score")).filter(F.lit(False))
    wanted = sorted({t for p in phrases for t in p})
    rows = mine.filter(F.col("term").isin(*wanted)).select("chunk_id", "doc_len", "term", "positions")
    doc = rows.groupBy("chunk_id").agg(
        F.first("doc_len").alias("doc_len"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m")
    )  # at most one row per term of the query
    none = F.array().cast("array<int>")

    def count(phrase: list[str]) -> Column:
        first = F.coalesce(F.try_element_at("m", F.lit(phrase[0])), none)
        for i, t in enumerate(phrase[1:], 1):
            back = F.lit(i)
            first = F.array_intersect(first, F.transform(F.coalesce(F.try_element_at("m", F.lit(t)), none), lambda x: (x - back).cast("int")))
        return F.size(first)

    counted = doc.select("chunk_id", "doc_len", *(count(p).alias(f"f{i}") for i, p in enumerate(phrases)))
    dfs = counted.agg(*(F.count(F.when(F.col(f"f{i}") > 0, 1)).alias(f"d{i}") for i in range(len(phrases)))).first()
    score = F.lit(0.0)
    for i in range(len(phrases)):
        if dfs[i]:
            score = score + _weight(_idf(n, dfs[i]), F.col(f"f{i}"), F.col("doc_len"), float(average))
    hits = counted.filter(F.greatest(*(F.col(f"f{i}") for i in range(len(phrases))), F.lit(0)) > 0)
    return hits.select("chunk_id", (-score).alias("bm25_score"))


def lexical_score(terms: list[str], path_col: str, text_col: str) -> Column:
    """3 for each term in the path, 1 for each in the content; terms are taken as they are."""
    path, text = F.lower(F.coalesce(F.col(path_col), F.lit(""))), F.lower(F.coalesce(F.col(text_col), F.lit("")))
    out = F.lit(0)
    for t in terms:
        out = out + F.when(path.contains(t), 3).otherwise(0) + F.when(text.contains(t), 1).otherwise(0)
    return out


def lexical_top_k(docs: DataFrame, terms: list[str], k: int, id_col: str, path_col: str, text_col: str, where: Column | None = None) -> DataFrame:
    """``docs`` with the highest path and content score, shorter contents first; ``bm25_score`` = -1000 - score."""
    if not terms:
        return docs.withColumn("bm25_score", F.lit(LEXICAL_BASE)).filter(F.lit(False))
    scored = docs.withColumn("__s", lexical_score(terms, path_col, text_col))
    hits = scored.filter(F.col("__s") > 0)
    hits = hits if where is None else hits.filter(where)
    best = hits.orderBy(F.desc("__s"), F.length(text_col), id_col).limit(max(1, k))
    return best.select(*docs.columns, (F.lit(LEXICAL_BASE) - F.col("__s")).cast("double").alias("bm25_score"))


def search(docs: DataFrame, query: str, k: int, id_col: str = "chunk_id", path_col: str = "filepath", text_col: str = "content", path: str | None = None) -> DataFrame:
    """Both ways of retrieval merged: the better score of each document, the k best, with ``rank``."""
    tokens = query_tokens(query)
    where = lexical_path_predicate(path, path_col) if path else None
    by_words = bm25(docs, tokens, id_col, text_col, where).orderBy("bm25_score", id_col).limit(max(1, k))
    by_path = lexical_top_k(docs, path_terms(tokens), k, id_col, path_col, text_col, where)
    return merge_best(by_words.withColumn("__o", F.lit(0)).unionByName(by_path.withColumn("__o", F.lit(1))), k, id_col)


def merge_best(hits: DataFrame, k: int, id_col: str) -> DataFrame:
    """The least score of each id with the columns of its first row (by ``__o``), the k best with ``rank``."""
    columns = [c for c in hits.columns if c not in ("bm25_score", "__o")]
    merged = hits.groupBy(id_col).agg(
        F.min("bm25_score").alias("bm25_score"), F.min_by(F.struct(*(c for c in columns if c != id_col)), "__o").alias("r")
    ).select(id_col, "r.*", "bm25_score")
    best = merged.orderBy("bm25_score", id_col).limit(max(1, k))
    return best.withColumn("rank", F.row_number().over(Window.orderBy("bm25_score", id_col)))


def concat_hits(parts: list[DataFrame], id_col: str) -> DataFrame:
    """Hits of several path filters one after the other: first occurrence of each id, not sorted or cut again."""
    out = None
    for n, part in enumerate(parts):
        p = part.withColumn("path_order", F.lit(n))
        out = p if out is None else out.unionByName(p)
    first = Window.partitionBy(id_col).orderBy("path_order", "rank")
    once = out.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n", "rank")
    return once.withColumn("rank", F.row_number().over(Window.orderBy("path_order", "bm25_score", id_col)))
