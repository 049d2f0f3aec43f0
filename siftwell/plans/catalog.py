"""Named queries over the test tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftwell.functions import ids, text, vectors
from siftwell.operators import chunking, delta, dense, embed, fusion, metrics, paths, rerank, sparse, store
from siftwell.session import spread, table
from siftwell.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

K = 30
GAP = 60.0
WORDS = "retry loop keeps the older value"
PHRASE = "older_value on_purpose"
PATH_WORDS = "parseToken worker"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def distinct_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks once each, named by workspace and chunk."""
    chunks = table(spark, d, "chunks").dropDuplicates(["workspace_id", "chunk_id"])
    return chunks.withColumn("key", F.concat_ws("/", "workspace_id", "chunk_id"))


_CHUNKS = "c AS (SELECT *, workspace_id || '/' || chunk_id AS key FROM (SELECT DISTINCT * FROM chunks))"

# vectors
# Components are compared on a grid of whole numbers, whose products add up exactly in any order.
_GRID = "list_transform(embedding, lambda x: floor(x::DOUBLE * 100000 + 0.5))"
_FIRST = f"q AS (SELECT {_GRID} AS qv FROM embeddings ORDER BY vec_id LIMIT 1)"
_COS = "list_cosine_similarity(e.embedding::DOUBLE[], {q}::DOUBLE[])"
_GRID_COS = "list_dot_product(g, qv) / (sqrt(list_dot_product(g, g)) * sqrt(list_dot_product(qv, qv)))"


def on_grid(df: DataFrame) -> DataFrame:
    return df.withColumn("embedding", F.transform("embedding", lambda x: F.floor(x.cast("double") * 100000 + 0.5).cast("double")))


def _first_vector(vectors_: DataFrame) -> list[float]:
    return vectors_.orderBy("vec_id").select("embedding").first()[0]


def _dense(sql_where: str) -> str:
    return f"""
        WITH {_FIRST}, g AS (SELECT vec_id, {_GRID} AS g FROM embeddings e {sql_where}), s AS (SELECT vec_id, 1 - {_GRID_COS} AS distance FROM g, q),
        t AS (SELECT *, row_number() OVER (ORDER BY distance, vec_id) AS rank FROM s)
        SELECT vec_id, round(distance, 6) AS distance, round(greatest(0, least(1, 1 - distance / 2)), 6) AS score, CAST(rank AS INT) AS rank FROM t WHERE rank <= {K}"""


def _six(hits: DataFrame, *columns: str) -> DataFrame:
    return hits.withColumns({c: r6(c) for c in columns})


@query(_dense(""))
def dense_topk(spark, d):
    e = on_grid(table(spark, d, "embeddings"))
    return _six(dense.top_k(e, _first_vector(e), K, "vec_id"), "distance", "score")


@query(_dense("WHERE e.label = 3"))
def dense_topk_filtered(spark, d):
    e = on_grid(table(spark, d, "embeddings"))
    return _six(dense.top_k(e, _first_vector(e), K, "vec_id", where=F.col("label") == 3), "distance", "score")


@query(f"""
    WITH p AS (SELECT q.vec_id AS query_id, e.vec_id, round({_COS.format(q='q.embedding')}, 6) AS cos
               FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
         t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id) AS rank FROM p)
    SELECT query_id, vec_id, cos, CAST(rank AS INT) AS rank FROM t WHERE rank <= 10""")
def dense_topk_multi(spark, d):
    """The query set of searches: rows whose id is divisible by 50, against all."""
    e = table(spark, d, "embeddings")
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.top_k_multi(e, queries, 10).withColumn("cos", r6("cos"))


@query(f"""
    WITH v AS (SELECT vec_id, g, sqrt(list_dot_product(g, g)) AS n FROM (SELECT vec_id, {_GRID} AS g FROM chunk_vectors WHERE embedding IS NOT NULL)),
         p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.g, e.g) / (q.n * e.n), 9) AS cos FROM v q JOIN v e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0 AND q.n > 0 AND e.n > 0),
         t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, vec_id) AS rank FROM p)
    SELECT query_id, vec_id, cos, CAST(rank AS INT) AS rank FROM t WHERE rank <= 10""")
def chunk_vector_search(spark, d):
    e = on_grid(table(spark, d, "chunk_vectors"))
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return dense.top_k_multi(e, queries, 10)


@query("""
    SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm FROM embeddings""")
def vector_norms(spark, d):
    return table(spark, d, "embeddings").select("vec_id", r6(vectors.norm(F.col("embedding"))).alias("norm"))


# lexical retrieval
_TERMS = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"
_DOC_TERMS = _TERMS.format("text")


@query(f"""
    SELECT count(*) AS n_docs, CAST(sum(len({_DOC_TERMS})) AS BIGINT) AS total_len, round(avg(len({_DOC_TERMS})), 6) AS avg_len FROM documents""")
def corpus_stats(spark, d):
    return sparse.corpus_stats(table(spark, d, "documents"), "text").withColumn("avg_len", r6("avg_len"))


_FOLDED = f"translate({{}}, '{sparse.FOLD_FROM}', '{sparse.FOLD_TO}')"


@query(f"""WITH w AS (SELECT doc_id, unnest({_TERMS.format(_FOLDED.format('text'))}) AS term FROM documents)
    SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM w GROUP BY 1""")
def term_stats(spark, d):
    return sparse.term_stats(table(spark, d, "documents"), "doc_id", "text")


@query(f"""WITH {_CHUNKS}, w AS (SELECT workspace_id, key, {_TERMS.format(_FOLDED.format('content'))} AS t FROM c),
    u AS (SELECT workspace_id, key, len(t) AS n, unnest(t) AS term FROM w)
    SELECT workspace_id, term, key AS chunk_id, CAST(count(*) AS INT) AS tf, CAST(any_value(n) AS INT) AS doc_len FROM u GROUP BY 1, 2, 3""")
def postings(spark, d):
    return sparse.build_postings(distinct_chunks(spark, d), "key").select("workspace_id", "term", "chunk_id", "tf", "doc_len")


def _bm25_sql(tokens: list[str]) -> str:
    """BM25 over the contents of chunks, phrases by counting them in a text of terms between blanks."""
    joined = "' ' || array_to_string(" + _TERMS.format("content") + ", '  ') || ' '"
    counts, weights, any_hit = [], [], []
    for i, t in enumerate(tokens):
        phrase = " " + "  ".join(sparse.terms_of(t)) + " "
        counts.append(f"(length(w) - length(replace(w, '{phrase}', ''))) / {len(phrase)} AS f{i}")
        idf = f"(SELECT CASE WHEN x <= 0 THEN 1e-6 ELSE x END FROM (SELECT ln((n - d{i} + 0.5) / (d{i} + 0.5)) AS x FROM s))"
        weights.append(f"{idf} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / (SELECT a FROM s)))")
        any_hit.append(f"f{i} > 0")
    dfs = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(tokens)))
    return f"""{_CHUNKS},
        w AS (SELECT key, filepath, content, language, len({_TERMS.format('content')}) AS len, {joined} AS w FROM c),
        f AS (SELECT *, {', '.join(counts)} FROM w),
        s AS (SELECT count(*) AS n, avg(len) AS a, {dfs} FROM f),
        b AS (SELECT key, filepath, content, language, round(-({' + '.join(weights)}), 6) AS bm25_score FROM f WHERE {' OR '.join(any_hit)})"""


_QUERY = text.query_tokens(WORDS)
_RANKED = "row_number() OVER (ORDER BY bm25_score, key)"


def _bm25(chunks: DataFrame, tokens: list[str], where: Column | None = None) -> DataFrame:
    return sparse.bm25(chunks, tokens, "key", "content", where).withColumn("bm25_score", r6("bm25_score"))


@query(f"WITH {_bm25_sql(_QUERY)} SELECT key, bm25_score FROM b ORDER BY bm25_score, key LIMIT {K}")
def bm25_topk(spark, d):
    return _bm25(distinct_chunks(spark, d), _QUERY).orderBy("bm25_score", "key").limit(K).select("key", "bm25_score")


_PHRASES = text.query_tokens(PHRASE)


@query(f"WITH {_bm25_sql(_PHRASES)} SELECT key, bm25_score FROM b ORDER BY bm25_score, key LIMIT {K}")
def bm25_phrase(spark, d):
    return _bm25(distinct_chunks(spark, d), _PHRASES).orderBy("bm25_score", "key").limit(K).select("key", "bm25_score")


@query(f"WITH {_bm25_sql(_QUERY)} SELECT key, bm25_score FROM b ORDER BY bm25_score, key LIMIT {K}")
def bm25_index(spark, d):
    """The same from postings."""
    index = sparse.build_postings(distinct_chunks(spark, d), "key")
    scored = sparse.bm25_from_postings(index, _QUERY).select(F.col("chunk_id").alias("key"), r6("bm25_score").alias("bm25_score"))
    return scored.orderBy("bm25_score", "key").limit(K)


_PATH_TERMS = text.path_terms(text.query_tokens(PATH_WORDS))
_SCORE = " + ".join(
    f"CASE WHEN contains(lower(filepath), '{t}') THEN 3 ELSE 0 END + CASE WHEN contains(lower(content), '{t}') THEN 1 ELSE 0 END" for t in _PATH_TERMS
)
_LEXICAL = f"l AS (SELECT key, filepath, content, language, CAST(-1000.0 - ({_SCORE}) AS DOUBLE) AS bm25_score, length(content) AS n FROM c WHERE ({_SCORE}) > 0)"


@query(f"WITH {_CHUNKS}, {_LEXICAL} SELECT key, bm25_score FROM l ORDER BY bm25_score, n, key LIMIT {K}")
def lexical_path_topk(spark, d):
    return sparse.lexical_top_k(distinct_chunks(spark, d), _PATH_TERMS, K, "key", "filepath", "content").select("key", "bm25_score")


_PATH_QUERY = text.query_tokens(PATH_WORDS)
_MERGED = f"""{_bm25_sql(_PATH_QUERY)}, {_LEXICAL},
        u AS (SELECT * FROM (SELECT key, filepath, content, language, bm25_score FROM b ORDER BY bm25_score, key LIMIT {K})
              UNION ALL SELECT * FROM (SELECT key, filepath, content, language, bm25_score FROM l ORDER BY bm25_score, n, key LIMIT {K})),
        m AS (SELECT key, min(bm25_score) AS bm25_score, min(filepath) AS filepath, min(content) AS content, min(language) AS language FROM u GROUP BY key),
        sp AS (SELECT *, row_number() OVER (ORDER BY bm25_score, key) AS rank FROM m)"""


def _sparse_hits(spark: SparkSession, d: str) -> DataFrame:
    chunks = distinct_chunks(spark, d)
    by_words = _bm25(chunks, _PATH_QUERY).orderBy("bm25_score", "key").limit(K)
    by_path = sparse.lexical_top_k(chunks, _PATH_TERMS, K, "key", "filepath", "content")
    return sparse.merge_best(by_words.withColumn("__o", F.lit(0)).unionByName(by_path.withColumn("__o", F.lit(1))), K, "key")


@query(f"WITH {_MERGED} SELECT key, bm25_score, CAST(rank AS INT) AS rank FROM sp WHERE rank <= {K}")
def sparse_merged(spark, d):
    return _sparse_hits(spark, d).select("key", "bm25_score", "rank")


@query(f"""WITH {_CHUNKS}, l AS (SELECT key, filepath, CAST(-1000.0 - ({_SCORE}) AS DOUBLE) AS bm25_score, length(content) AS n FROM c
        WHERE ({_SCORE}) > 0 AND (starts_with(filepath, 'src/') OR contains(filepath, '/src/')))
    SELECT key, bm25_score FROM l ORDER BY bm25_score, n, key LIMIT {K}""")
def lexical_topk_scoped(spark, d):
    """Path predicate before the limit."""
    where = F.col("filepath").startswith("src/") | F.col("filepath").contains("/src/")
    return sparse.lexical_top_k(distinct_chunks(spark, d), _PATH_TERMS, K, "key", "filepath", "content", where).select("key", "bm25_score")


# fusion
_V = "v AS (SELECT min(vec_id) AS vec_id, key, any_value(embedding) AS embedding FROM (SELECT vec_id, workspace_id || '/' || chunk_id AS key, embedding FROM chunk_vectors WHERE embedding IS NOT NULL) WHERE vec_id IN (SELECT min(vec_id) FROM chunk_vectors WHERE embedding IS NOT NULL GROUP BY workspace_id, chunk_id) GROUP BY key)"
_DENSE = f"""{_V}, vg AS (SELECT key, vec_id, {_GRID} AS g FROM v), q AS (SELECT g AS qv FROM vg ORDER BY vec_id LIMIT 1),
        ds AS (SELECT key, 1 - CASE WHEN list_dot_product(g, g) > 0 THEN {_GRID_COS} ELSE 0 END AS distance FROM vg, q),
        de AS (SELECT key, round(greatest(0, least(1, 1 - distance / 2)), 6) AS score, row_number() OVER (ORDER BY distance, key) AS rank FROM ds)"""
_RRF = f"""{_MERGED}, {_DENSE},
        j AS (SELECT coalesce(d.key, s.key) AS key, d.score AS dense_score, d.rank AS dense_rank, s.bm25_score, s.rank AS sparse_rank,
                     round(coalesce(1 / (60.0 + d.rank), 0) + coalesce(1 / (60.0 + s.rank), 0), 12) AS hs
              FROM (SELECT * FROM de WHERE rank <= {K}) d FULL JOIN (SELECT * FROM sp WHERE rank <= {K}) s ON d.key = s.key),
        fu AS (SELECT *, row_number() OVER (ORDER BY hs DESC, coalesce(dense_score, 0) DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, key) AS fused_rank FROM j),
        top AS (SELECT * FROM fu WHERE fused_rank <= {K})"""
_RRF_OUT = """key, round(hs, 9) AS hybrid_score, dense_score, bm25_score, CAST(fused_rank AS INT) AS fused_rank,
    CASE WHEN dense_rank IS NOT NULL AND sparse_rank IS NOT NULL THEN 'both' WHEN dense_rank IS NOT NULL THEN 'dense' ELSE 'sparse' END AS source"""


def _dense_hits(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "chunk_vectors").filter("embedding IS NOT NULL")
    first = v.groupBy("workspace_id", "chunk_id").agg(F.min(F.struct("vec_id", "embedding")).alias("m"))
    v = on_grid(first.select(F.concat_ws("/", "workspace_id", "chunk_id").alias("key"), "m.vec_id", "m.embedding"))
    return _six(dense.top_k(v, _first_vector(v), K, "key"), "distance", "score")


def _fused(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(_dense_hits(spark, d), _sparse_hits(spark, d), K, "key")


def _fused_columns(df: DataFrame) -> DataFrame:
    return df.select("key", F.round("hybrid_score", 9).alias("hybrid_score"), "dense_score", "bm25_score", "fused_rank", "source")


@query(f"WITH {_RRF} SELECT {_RRF_OUT} FROM top")
def rrf_fusion(spark, d):
    return _fused_columns(_fused(spark, d))


@query(f"WITH {_RRF} SELECT {_RRF_OUT.replace('key,', 'top.key,', 1)}, c.filepath, c.language FROM top JOIN c ON c.key = top.key WHERE regexp_matches(c.content, '(?i)return [a-z_]+')")
def hybrid_search(spark, d):
    """The flagship: both retrievals, fusion, then the regular expression on what was fused."""
    hits = _fused_columns(_fused(spark, d))
    texts = distinct_chunks(spark, d).select("key", "filepath", "language", "content")
    return texts.join(F.broadcast(hits), "key").filter(F.col("content").rlike("(?i)return [a-z_]+")).drop("content")  # at most K rows


@query(f"WITH {_bm25_sql(_QUERY)}, t AS (SELECT * FROM b ORDER BY bm25_score, key LIMIT {K}) SELECT key, bm25_score FROM t WHERE regexp_matches(content, '(?i)log\\.(info|println)')")
def regex_postfilter(spark, d):
    best = _bm25(distinct_chunks(spark, d), _QUERY).orderBy("bm25_score", "key").limit(K)
    return fusion.regex_filter(best, r"log\.(info|println)").select("key", "bm25_score")


_HEAD = 12
_OVERLAP = " + ".join(f"CASE WHEN contains(lower(c.content), '{w}') THEN 1 ELSE 0 END" for w in dict.fromkeys(text.content_words(PATH_WORDS)))


@query(f"""WITH {_RRF}, x AS (SELECT top.key, fused_rank, CASE WHEN fused_rank <= {_HEAD} THEN CAST({_OVERLAP} AS DOUBLE) END AS rerank_score FROM top LEFT JOIN c ON c.key = top.key)
    SELECT key, CAST(fused_rank AS INT) AS fused_rank, coalesce(rerank_score, CASE WHEN fused_rank <= {_HEAD} THEN 0 END) AS rerank_score,
    CAST(row_number() OVER (ORDER BY CASE WHEN fused_rank <= {_HEAD} THEN 0 ELSE 1 END, coalesce(rerank_score, 0) DESC, fused_rank) AS INT) AS final_rank FROM x""")
def rerank_head_tail(spark, d):
    texts = distinct_chunks(spark, d).select("key", "content")
    hits = texts.join(F.broadcast(_fused(spark, d)), "key", "right")  # at most K rows
    ordered = fusion.order_reranked(hits, _HEAD, rerank.overlap_col(PATH_WORDS, F.col("content")))
    return ordered.select("key", "fused_rank", "rerank_score", "final_rank")


@query()
def rerank_model(spark, d):
    """Scores of the default reranker on the head."""
    texts = distinct_chunks(spark, d).select("key", "content")
    hits = texts.join(F.broadcast(_fused(spark, d).filter(F.col("fused_rank") <= _HEAD)), "key")
    return fusion.order_reranked(hits, _HEAD, rerank.score_column(PATH_WORDS, F.col("content"))).select("key", r6("rerank_score").alias("rerank_score"), "final_rank")


# paths and metadata
def _path_query(name: str, wanted: str, condition: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return paths.resolve_paths(table(spark, d, "chunks"), wanted)

    run.__name__ = name
    query(f"SELECT DISTINCT filepath FROM chunks WHERE {condition}")(run)


_path_query("path_filter_dir", "gateway/src/codegen", "starts_with(filepath, 'src/codegen/') OR starts_with(filepath, 'gateway/src/codegen/')")
_path_query("path_filter_basename", "config.go", "filepath = 'config.go' OR suffix(filepath, '/config.go')")


@query("""WITH f AS (SELECT min(filepath) AS w FROM chunks WHERE filepath LIKE 'src/%')
    SELECT DISTINCT filepath FROM chunks, f WHERE filepath = w OR suffix(filepath, '/' || w)""")
def path_filter_exact(spark, d):
    chunks = table(spark, d, "chunks")
    one = chunks.filter(F.col("filepath").startswith("src/")).agg(F.min("filepath")).first()[0]
    return paths.resolve_paths(chunks, "/gateway/" + one) if one else chunks.select("filepath").limit(0)


@query("""SELECT workspace_id, chunk_id, filepath FROM chunks WHERE language IN ('go', 'rs') AND chunk_type = 'file'""")
def meta_in_filter(spark, d):
    return table(spark, d, "chunks").filter(F.col("language").isin("go", "rs") & (F.col("chunk_type") == "file")).select("workspace_id", "chunk_id", "filepath")


@query("""SELECT workspace_id, chunk_id, filepath FROM chunks WHERE filepath LIKE 'cmd/%' AND language = 'go'""")
def meta_conjunction(spark, d):
    where = paths.metadata_predicate(language="go") & F.col("filepath").startswith("cmd/")
    return table(spark, d, "chunks").filter(where).select("workspace_id", "chunk_id", "filepath")


@query("SELECT DISTINCT workspace_id, filepath, language FROM chunks")
def metadata_scan(spark, d):
    return table(spark, d, "chunks").select("workspace_id", "filepath", "language").distinct()


# scalars
@query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INT) AS tokens FROM documents")
def token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.coalesce(text.estimate_tokens_col(F.col("text")), F.lit(1)).alias("tokens"))


@query("""SELECT DISTINCT filepath, lower(regexp_extract(filepath, '(?:^|/)[^/]+\\.([^./]+)$', 1)) AS suffix FROM chunks""")
def language_of(spark, d):
    return table(spark, d, "chunks").select("filepath", text.suffix_col(F.col("filepath")).alias("suffix")).distinct()


@query("""SELECT DISTINCT filepath, CASE lower(regexp_extract(filepath, '(?:^|/)[^/]+\\.([^./]+)$', 1))
    WHEN 'py' THEN 'python' WHEN 'go' THEN 'go' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'java' THEN 'java' WHEN 'rs' THEN 'rust'
    WHEN 'tsx' THEN 'tsx' WHEN 'jsx' THEN 'jsx' WHEN 'c' THEN 'c' WHEN 'h' THEN 'c' WHEN 'cpp' THEN 'cpp' WHEN 'hpp' THEN 'cpp' WHEN 'rb' THEN 'ruby' WHEN 'swift' THEN 'swift'
    WHEN 'kt' THEN 'kotlin' WHEN 'scala' THEN 'scala' WHEN 'php' THEN 'php' WHEN 'bash' THEN 'bash' WHEN 'zsh' THEN 'bash' WHEN 'fish' THEN 'fish' WHEN 'ps1' THEN 'powershell'
    WHEN 'sql' THEN 'sql' WHEN 'html' THEN 'html' WHEN 'scss' THEN 'scss' WHEN 'sass' THEN 'sass' WHEN 'less' THEN 'less' WHEN 'vue' THEN 'vue' WHEN 'svelte' THEN 'svelte'
    WHEN 'xml' THEN 'xml' WHEN 'md' THEN 'markdown' WHEN 'rst' THEN 'rst' WHEN 'csv' THEN 'csv' WHEN 'dockerfile' THEN 'dockerfile' WHEN 'makefile' THEN 'makefile'
    WHEN 'json' THEN 'json' WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' WHEN 'toml' THEN 'toml' WHEN 'sh' THEN 'bash' WHEN 'css' THEN 'css' ELSE '' END AS fence FROM chunks""")
def fence_of(spark, d):
    return table(spark, d, "chunks").select("filepath", text.fence_name_col(F.col("filepath")).alias("fence")).distinct()


@query("""SELECT DISTINCT workspace_id, chunk_id, md5(CASE WHEN chunk_type = 'file' THEN filepath || ':file' WHEN chunk_type = 'code_block' THEN filepath || ':block:' || start_line
    WHEN suffix(chunk_type, '_declaration') THEN filepath || ':' || chunk_type || ':' || name || ':' || start_line
    ELSE filepath || ':' || chunk_type || ':' || coalesce(parent, '') || ':' || name || ':' || start_line END) = chunk_id AS same FROM chunks""")
def chunk_ids(spark, d):
    """Whether ids follow from the columns."""
    key = ids.chunk_id_col(*(F.col(c) for c in ("filepath", "chunk_type", "parent", "name", "start_line")))
    return table(spark, d, "chunks").select("workspace_id", "chunk_id", (key == F.col("chunk_id")).alias("same")).distinct()


@query("""SELECT workspace_id, regexp_replace(regexp_replace(lower(slug), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug_id,
    regexp_replace(regexp_replace(lower(slug), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '_' || substr(sha1(root_path), 1, 10) AS derived FROM workspaces""")
def workspace_ids(spark, d):
    w = table(spark, d, "workspaces")
    return w.select("workspace_id", ids.sanitize_id_col(F.col("slug")).alias("slug_id"), ids.workspace_id_col(F.col("root_path")).alias("derived"))


@query("""SELECT workspace_id, 'chunks__' || CASE WHEN length(workspace_id) > 40 THEN substr(workspace_id, 1, 29) || '_' || substr(sha1(workspace_id), 1, 10) ELSE workspace_id END AS collection
    FROM workspaces""")
def collection_names(spark, d):
    return table(spark, d, "workspaces").select("workspace_id", ids.collection_name_col("chunks", F.col("workspace_id")).alias("collection"))


@query()
def query_tokens(spark, d):
    items = table(spark, d, "eval_items").withColumn("tokens", text.query_tokens_col(F.col("text")))
    return items.select("item_id", F.array_join("tokens", " ").alias("tokens"), F.array_join(text.path_terms_col(F.col("tokens")), " ").alias("path_terms"))


@query()
def camel_tokens(spark, d):
    names = table(spark, d, "chunks").filter("name IS NOT NULL").select("name").distinct()
    return names.select("name", F.array_join(text.case_pieces_col(F.col("name")), " ").alias("pieces"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_CODE = ", ".join(f"'{w}'" for w in sorted(set(text.CODE_WORDS)))
_QWORDS = "list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9_ \\n]', ' ', 'g'), '[ \\n]+'), lambda w: length(w) > 1)"


@query(f"""WITH w AS (SELECT item_id, text, {_QWORDS} AS every FROM eval_items),
    x AS (SELECT *, len(list_filter(every, lambda w: NOT list_contains([{_STOP}], w))) AS n, len(list_filter([{_CODE}], lambda k: contains(lower(text), k))) AS kw FROM w)
    SELECT item_id, CAST(n AS INT) AS content_words, n >= 8 OR regexp_matches(text, '[{{}}();=<>+\\-*/%&|^~!@#]') AS complex,
    length(trim(text)) < 8 OR n < 4 OR (NOT regexp_matches(text, '[{{}}();=<>+*\\-/&|^!@#%]') AND kw = 0 AND n <= 6) AS skip FROM x""")
def query_analysis(spark, d):
    t = F.col("text")
    return table(spark, d, "eval_items").select(
        "item_id", F.size(text.content_words_col(t)).alias("content_words"), text.is_complex_query_col(t).alias("complex"), text.skip_rerank_col(t).alias("skip")
    )


@query(f"""WITH w AS (SELECT item_id, len(list_filter({_QWORDS}, lambda w: NOT list_contains([{_STOP}], w))) AS n FROM eval_items)
    SELECT item_id, CASE WHEN n = 0 THEN '{text.WARN_STOPWORDS}' WHEN n = 1 THEN '{text.WARN_SHORT}' END AS warning FROM w""")
def quality_warnings(spark, d):
    return table(spark, d, "eval_items").select("item_id", text.quality_warning_col(F.col("text"), F.lit(0)).alias("warning"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", ids.content_hash_col(F.col("text").cast("binary")).alias("digest"))


# chunking
@query()
def chunk_upstream(spark, d):
    u = table(spark, d, "upstream_files").select(F.col("lib_name").alias("workspace_id"), "filepath", "content")
    return chunking.chunk_files(u).drop("content")


@query("""WITH RECURSIVE f AS (SELECT doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents),
    g AS (SELECT doc_id, string_split(t, chr(10)) AS a FROM f),
    h AS (SELECT doc_id, list_filter(list_transform(range(1, len(a) + 1), lambda i: length(a[i]) + CASE WHEN i < len(a) THEN 1 ELSE 0 END), lambda x: true) AS z, a FROM g),
    n AS (SELECT doc_id, CASE WHEN a[len(a)] = '' THEN z[1:len(z) - 1] ELSE z END AS z FROM h),
    s AS (SELECT doc_id, z, 0 AS i, 1 AS first, 0 AS chars, 1 AS block FROM n
          UNION ALL SELECT doc_id, z, i + 1, CASE WHEN chars > 0 AND chars + z[i + 1] > 4000 THEN i + 1 ELSE first END,
                 CASE WHEN chars > 0 AND chars + z[i + 1] > 4000 THEN z[i + 1] ELSE chars + z[i + 1] END,
                 CASE WHEN chars > 0 AND chars + z[i + 1] > 4000 THEN block + 1 ELSE block END FROM s WHERE i < len(z))
    SELECT doc_id, CAST(first AS INT) AS start_line, CAST(max(i) AS INT) AS end_line, CAST(max(chars) AS INT) AS chars FROM s WHERE i > 0 GROUP BY doc_id, first""")
def line_blocks(spark, d):
    """Greedy packing of lines as a fold in the JVM."""
    docs = table(spark, d, "documents").select("doc_id", F.regexp_replace("text", "\\r\\n?", "\n").alias("text"))
    return docs.select("doc_id", F.inline(chunking.block_spans_col("text")))


@query("""WITH a AS (SELECT lib_name, string_split(content, chr(10)) AS l FROM upstream_files),
    b AS (SELECT lib_name, CASE WHEN l[len(l)] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM a)
    SELECT lib_name, CAST(i AS INT) AS line_no, lpad(CAST(i AS VARCHAR), CAST(length(CAST(len(l) AS VARCHAR)) AS INT), ' ') || ' | ' || l[i] AS line FROM b, range(1, 100000) r(i) WHERE i <= len(l)""")
def line_numbered(spark, d):
    lines = F.expr("CASE WHEN endswith(content, '\n') THEN slice(split(content, '\n'), 1, size(split(content, '\n')) - 1) ELSE split(content, '\n') END")
    rows = table(spark, d, "upstream_files").withColumn("l", lines).select("lib_name", F.size("l").alias("n"), F.posexplode("l").alias("p", "x"))
    number = F.lpad((F.col("p") + 1).cast("string"), F.length(F.col("n").cast("string")), " ")
    return rows.select("lib_name", (F.col("p") + 1).alias("line_no"), F.concat(number, F.lit(" | "), "x").alias("line"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN length(text) <= 300 THEN [trim(text)] ELSE [trim(substr(text, 1, 300)), trim(substr(text, CAST((length(text) - 300) // 2 AS INT) + 1, 300)), trim(substr(text, length(text) - 299, 300))] END AS p FROM documents)
    SELECT DISTINCT doc_id, x AS snippet FROM (SELECT doc_id, unnest(p) AS x FROM s) WHERE length(x) > 0""")
def snippets(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.explode(text.snippets_col(F.col("text"), 300)).alias("snippet"))


# hashes, deltas and merges
_IN_FILE = "PARTITION BY workspace_id, filepath ORDER BY s, e DESC, t"
_LINES = "(length(t) - length(replace(t, chr(10), '')) + CASE WHEN t <> '' AND NOT suffix(t, chr(10)) THEN 1 ELSE 0 END)"
#: Files put together from their chunks: what no earlier chunk holds of each, blank lines where no chunk holds any.
_FILES = f"""o AS (SELECT DISTINCT workspace_id, filepath, coalesce(start_line, 1) AS s, coalesce(end_line, 1) AS e, coalesce(content, '') AS t, coalesce(chunk_type = 'file', false) AS whole
          FROM chunks WHERE filepath IS NOT NULL),
    pl AS (SELECT *, 1 + coalesce(max(e) OVER ({_IN_FILE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS due FROM o),
    hd AS (SELECT *, CASE WHEN starts_with(t, '# Class: ') AND {_LINES} = e - s + 2 THEN substr(t, strpos(t, chr(10)) + 1) ELSE t END AS u FROM pl WHERE e >= due),
    dr AS (SELECT * REPLACE (CASE WHEN s < due THEN array_to_string(string_split(u, chr(10))[due - s + 1:], chr(10)) ELSE u END AS u) FROM hd),
    pr AS (SELECT *, lag(u) OVER ({_IN_FILE}) AS p, CASE WHEN coalesce(bool_or(suffix(u, chr(13) || chr(10))) OVER ({_IN_FILE} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
          THEN chr(13) || chr(10) ELSE chr(10) END AS nl FROM dr),
    pc AS (SELECT *, CASE WHEN p IS NOT NULL AND NOT suffix(p, chr(10)) AND NOT suffix(p, chr(13)) AND (s > due OR s = due AND u <> '') THEN nl ELSE '' END
          || CASE WHEN s > due THEN repeat(nl, s - due) ELSE '' END || u AS piece FROM pr),
    fi AS (SELECT workspace_id, filepath, string_agg(piece, '' ORDER BY s, e DESC, t) AS text FROM pc GROUP BY 1, 2)"""
_STORED = "sto AS (SELECT workspace_id, filepath, max(lower(file_hash)) AS h FROM file_hashes WHERE filepath IS NOT NULL GROUP BY 1, 2)"
#: Blank lines at the end of a cut file are in no chunk: the stored hash is tried with them.
_CURRENT = f"""{_STORED}, {_FILES},
    wh AS (SELECT workspace_id, filepath, bool_and(whole) AS whole, max(sha256(t)) AS h FROM o GROUP BY 1, 2),
    fh AS (SELECT f.workspace_id, f.filepath, w.whole, f.text, CASE WHEN w.whole THEN w.h ELSE sha256(f.text) END AS h FROM fi f JOIN wh w ON w.workspace_id IS NOT DISTINCT FROM f.workspace_id AND w.filepath = f.filepath),
    bl AS (SELECT x.workspace_id, x.filepath, x.sh FROM (SELECT f.*, st.h AS sh, unnest(range(1, {delta.BLANK_ENDS} + 1)) AS k FROM fh f JOIN sto st ON st.workspace_id IS NOT DISTINCT FROM f.workspace_id AND st.filepath = f.filepath
          WHERE NOT f.whole AND st.h <> f.h) x WHERE sha256(x.text || repeat(CASE WHEN suffix(x.text, chr(13) || chr(10)) THEN chr(13) || chr(10) ELSE chr(10) END, k)) = x.sh),
    cur AS (SELECT f.workspace_id, f.filepath, coalesce(b.sh, f.h) AS h FROM fh f LEFT JOIN bl b ON b.workspace_id IS NOT DISTINCT FROM f.workspace_id AND b.filepath = f.filepath)"""
_DELTA = f"""{_CURRENT}, dl AS (SELECT coalesce(c.workspace_id, s.workspace_id) AS workspace_id, coalesce(c.filepath, s.filepath) AS filepath,
    CASE WHEN c.filepath IS NULL THEN 'deleted' WHEN s.filepath IS NULL THEN 'new' WHEN c.h <> s.h THEN 'modified' ELSE 'unchanged' END AS status,
    c.h AS current_hash, s.h AS stored_hash FROM cur c FULL JOIN sto s ON c.workspace_id = s.workspace_id AND c.filepath = s.filepath)"""


def _current(spark: SparkSession, d: str) -> DataFrame:
    return delta.hash_chunked(table(spark, d, "chunks"), table(spark, d, "file_hashes"))


@query(f"WITH {_DELTA} SELECT * FROM dl")
def delta_classify(spark, d):
    return delta.classify(_current(spark, d), table(spark, d, "file_hashes"))


@query(f"WITH {_DELTA} SELECT workspace_id, filepath FROM dl WHERE status = 'deleted'")
def delta_deletes(spark, d):
    return delta.deleted(table(spark, d, "chunks"), table(spark, d, "file_hashes"))


@query(f"WITH {_DELTA} SELECT workspace_id, filepath FROM dl WHERE status <> 'unchanged'")
def delta_replace(spark, d):
    return delta.to_replace(delta_classify(spark, d))


@query(f"""WITH {_DELTA} SELECT workspace_id, count(*) FILTER (WHERE status = 'new') AS new_files, count(*) FILTER (WHERE status = 'modified') AS modified_files,
    count(*) FILTER (WHERE status = 'unchanged') AS unchanged_files, count(*) FILTER (WHERE status = 'deleted') AS deleted_files,
    count(*) FILTER (WHERE status <> 'unchanged') AS changed_or_deleted FROM dl GROUP BY 1""")
def delta_summary(spark, d):
    return delta.summary(delta_classify(spark, d))


@query(f"""WITH {_CURRENT} SELECT * FROM cur UNION ALL SELECT * FROM sto s WHERE NOT EXISTS
    (SELECT 1 FROM cur c WHERE c.workspace_id = s.workspace_id AND c.filepath = s.filepath)""")
def upsert_merge(spark, d):
    """Stored hashes replaced by current ones."""
    stored = table(spark, d, "file_hashes").groupBy("workspace_id", "filepath").agg(F.max(F.lower("file_hash")).alias("h"))
    return store.upsert(stored, _current(spark, d).withColumnRenamed("file_hash", "h"), ["workspace_id", "filepath"])


@query(f"""WITH {_CURRENT} SELECT DISTINCT c.workspace_id, c.chunk_id, c.filepath FROM chunks c WHERE NOT EXISTS
    (SELECT 1 FROM (SELECT * FROM cur WHERE h < '4') x WHERE x.workspace_id = c.workspace_id AND x.filepath = c.filepath)""")
def delete_by_files(spark, d):
    """Chunks without those of a set of files."""
    gone = _current(spark, d).withColumnRenamed("file_hash", "h").filter("h < '4'")
    chunks = table(spark, d, "chunks").select("workspace_id", "chunk_id", "filepath").distinct()
    return store.delete(chunks, gone, ["workspace_id", "filepath"])


@query("SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1")
def dedup_content(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return docs.groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))


@query("""WITH o AS (SELECT DISTINCT workspace_id, chunk_id, filepath, token_count FROM chunks)
    SELECT workspace_id, count(*) AS chunks, count(DISTINCT filepath) AS files, CAST(sum(token_count) AS BIGINT) AS tokens FROM o GROUP BY 1""")
def db_status(spark, d):
    return store.workspace_status(table(spark, d, "chunks"))


@query("SELECT DISTINCT workspace_id, filepath, lower(file_hash) AS file_hash FROM file_hashes")
def hash_scan(spark, d):
    return table(spark, d, "file_hashes").select("workspace_id", "filepath", F.lower("file_hash").alias("file_hash")).distinct()


# embedding
@query()
def embed_documents(spark, d):
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("e", embed.embed_column(F.col("text")))
    return docs.select("doc_id", F.size("e").alias("dim"), r6(vectors.norm(F.col("e"))).alias("norm"))


@query("""WITH RECURSIVE l AS (SELECT workspace_id, token_count AS n, row_number() OVER (PARTITION BY workspace_id ORDER BY token_count, filepath, chunk_id) AS i
        FROM (SELECT DISTINCT workspace_id, chunk_id, filepath, token_count FROM chunks)),
    s AS (SELECT workspace_id, i, n, 0 AS batch, 1 AS items FROM l WHERE i = 1
          UNION ALL SELECT l.workspace_id, l.i, l.n, CASE WHEN items < 32 AND (items + 1) * l.n <= 8192 THEN batch ELSE batch + 1 END,
                 CASE WHEN items < 32 AND (items + 1) * l.n <= 8192 THEN items + 1 ELSE 1 END FROM s JOIN l ON l.workspace_id = s.workspace_id AND l.i = s.i + 1)
    SELECT workspace_id, CAST(batch AS INT) AS batch, count(*) AS items, CAST(max(n) AS INT) AS longest FROM s GROUP BY 1, 2""")
def batch_plan(spark, d):
    once = table(spark, d, "chunks").select("workspace_id", "chunk_id", "filepath", "token_count").distinct()
    return embed.batch_table(once, "workspace_id", "token_count", 32, 8192)


# metrics
_QRELS = """qr AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, 1.0 AS rel FROM embeddings q JOIN embeddings e ON e.label = q.label AND e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)"""
_RUN = f"""pr AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round({_COS.format(q='q.embedding')}, 9) AS cos FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cos DESC, doc_id) AS rank FROM pr),
    hi AS (SELECT qr.*, CASE WHEN rank <= 12 THEN rank END AS rank, row_number() OVER (PARTITION BY qr.query_id ORDER BY rel DESC, qr.doc_id) AS ideal FROM qr LEFT JOIN rk ON rk.query_id = qr.query_id AND rk.doc_id = qr.doc_id)"""
_METRIC = f"""WITH {_QRELS}, {_RUN} SELECT query_id, round(coalesce(1.0 / min(rank) FILTER (WHERE rank <= 5), 0), 6) AS mrr, round(count(rank) / count(*)::DOUBLE, 6) AS recall,
    round(coalesce(sum((2 ** rel - 1) / log2(rank + 1)), 0) / sum((2 ** rel - 1) / log2(ideal + 1)) FILTER (WHERE ideal <= 12), 6) AS ndcg FROM hi GROUP BY 1"""


def _evaluated(spark: SparkSession, d: str) -> DataFrame:
    """Relevant to a query vector are the vectors of its label."""
    e = table(spark, d, "embeddings")
    queries = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("ql"))
    ranked = dense.top_k_multi(e, queries, 12).withColumnRenamed("vec_id", "doc_id")
    qrels = queries.join(e.select(F.col("vec_id").alias("doc_id"), "label"), (F.col("label") == F.col("ql")) & (F.col("doc_id") != F.col("query_id")))
    return metrics.evaluate(ranked, qrels.select("query_id", "doc_id", F.lit(1.0).alias("rel")))


@query(_METRIC)
def retrieval_metrics(spark, d):
    return _evaluated(spark, d).select("query_id", r6("mrr").alias("mrr"), r6("recall").alias("recall"), r6("ndcg").alias("ndcg"))


@query(f"WITH m AS ({_METRIC}) SELECT count(*) AS queries, round(avg(mrr), 4) AS mrr, round(avg(recall), 4) AS recall, round(avg(ndcg), 4) AS ndcg FROM m")
def metrics_macro(spark, d):
    m = metrics.macro_average(retrieval_metrics(spark, d))
    return m.select("queries", *(F.round(c, 4).alias(c) for c in ("mrr", "recall", "ndcg")))


# events
_SKIP = ", ".join(f"'{x}'" for x in paths.SKIP_FOLDERS)
_EVENTS = f"""ev0 AS (SELECT event_id, workspace_id, regexp_replace(regexp_replace(replace(path, chr(92), '/'), '^(\\./)+', ''), '^/+|/+$', '', 'g') AS path,
        CASE WHEN event_type IN ('created', 'modified', 'deleted') THEN event_type ELSE 'modified' END AS event_type, event_ts, arrived_at
        FROM watch_events WHERE workspace_id IS NOT NULL AND path IS NOT NULL AND event_ts IS NOT NULL),
    ev1 AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY arrived_at, workspace_id, path, event_type, event_ts) AS copy FROM ev0
        WHERE path <> '' AND NOT list_has_any(string_split(path, '/'), [{_SKIP}])),
    ev AS (SELECT * FROM ev1 WHERE copy = 1)"""
_SESSIONS = f"""{_EVENTS}, lg AS (SELECT *, lag(event_ts) OVER (PARTITION BY workspace_id ORDER BY event_ts, event_id) AS p FROM ev),
    se AS (SELECT *, sum(CASE WHEN p IS NULL OR event_ts - p > {GAP} THEN 1 ELSE 0 END) OVER (PARTITION BY workspace_id ORDER BY event_ts, event_id ROWS UNBOUNDED PRECEDING) AS session_no FROM lg)"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    return watch.clean_events(table(spark, d, "watch_events"))


@query(f"""WITH {_EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, path ORDER BY arrived_at DESC, event_id DESC) AS n FROM ev)
    SELECT workspace_id, path, event_type FROM r WHERE n = 1""")
def events_coalesce(spark, d):
    return watch.coalesce_events(_events(spark, d), ["arrived_at", "event_id"])


@query(f"""WITH {_SESSIONS} SELECT workspace_id, CAST(session_no AS BIGINT) AS session_no, min(event_ts) AS first_ts, max(event_ts) AS last_ts, count(*) AS events,
    count(DISTINCT path) AS paths FROM se GROUP BY 1, 2""")
def debounce_sessions(spark, d):
    return watch.debounce_sessions(_events(spark, d), GAP)


@query(f"""WITH {_SESSIONS}, la AS (SELECT *, row_number() OVER (PARTITION BY workspace_id, session_no, path ORDER BY arrived_at DESC, event_id DESC) AS n FROM se),
    ac AS (SELECT workspace_id, session_no, path, CASE WHEN event_type = 'deleted' THEN 'delete' ELSE 'touch' END AS action, regexp_replace(path, '[^/]*$', '') AS folder FROM la WHERE n = 1)
    SELECT workspace_id, CAST(session_no AS BIGINT) AS session_no, action, path,
    CAST((row_number() OVER (PARTITION BY workspace_id, session_no, action ORDER BY folder, path) - 1) // 10 AS INT) AS batch_no FROM ac""")
def event_microbatches(spark, d):
    return watch.micro_batches(_events(spark, d), GAP)


@query("""SELECT event_id, path, path IS NOT NULL AND trim(replace(path, chr(92), '/')) <> '' AND NOT starts_with(replace(path, chr(92), '/'), '/')
    AND NOT list_contains(string_split(replace(path, chr(92), '/'), '/'), '..') AS safe FROM watch_events WHERE path IS NOT NULL""")
def safe_paths(spark, d):
    return table(spark, d, "watch_events").filter("path IS NOT NULL").select("event_id", "path", paths.safe_relative_col(F.col("path")).alias("safe"))
