import sqlite3

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.functions.text import query_tokens
from siftwell.operators import dense, embed, fusion, lsh, metrics, rerank, sparse

CHUNKS = [
    ("a1", "service/pricing.go", "func CalculateProductPrice(qty int, unit int) int { return qty * unit }", "go"),
    ("a2", "service/pricing.go", "func ApplyDiscount(price int) int { return price - 1 }", "go"),
    ("b1", "service/cart.go", "func ApplyDiscount(cart Cart) Cart { return cart }", "go"),
]


def frame(spark, rows=CHUNKS):
    return spark.createDataFrame(rows, "chunk_id string, filepath string, content string, language string")


def test_symbol_first_and_scopes(spark):
    df = frame(spark)
    assert sparse.search(df, "CalculateProductPrice", 5).first().chunk_id == "a1"
    assert sparse.search(df, "ApplyDiscount", 5, path="service/cart.go").first().chunk_id == "b1"
    assert sparse.search(df, "CalculateProductPrice", 5, path="pricing.go").first().chunk_id == "a1"
    left = df.filter("filepath <> 'service/pricing.go'")
    assert "a1" not in [r.chunk_id for r in sparse.search(left, "CalculateProductPrice", 5).collect()]
    assert sparse.search(df, "", 5).count() == 0 and sparse.search(df.limit(0), "price", 5).count() == 0


def test_plural_path_recall(spark):
    rows = [("d", "internal/worker/daemons.go", "package worker", "go"), ("e", "configs/banners.json", "{\"function\": 1}", "json")]
    assert sparse.search(frame(spark, rows), "daemon function", 5).first().chunk_id == "d"


def test_full_path_does_not_leak(spark):
    rows = [(n, f"src/{n}/data.go", "func Load() {}", "go") for n in ("swpulsa", "host", "other")]
    df = frame(spark, rows)
    hits = lambda p: sorted(r.chunk_id for r in sparse.search(df, "Load", 9, path=p).collect())
    assert hits("src/swpulsa/data.go") == ["swpulsa"] and hits("data.go") == ["host", "other", "swpulsa"]


DOCS = ["the quick brown fox", "quick quick dog_house", "lazy dog house naïve", "", "fox fox fox jumps over dog house", "Unrelated text"]


def fts(query):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(x, tokenize='unicode61 remove_diacritics 2')")
    con.executemany("INSERT INTO t(rowid, x) VALUES (?, ?)", [(i + 1, d) for i, d in enumerate(DOCS)])
    match = " OR ".join(f'"{q}"' for q in query)
    return {i - 1: s for i, s in con.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}


@pytest.mark.parametrize("query", [["fox"], ["quick", "dog"], ["dog_house", "fox"], ["naive"], ["missing"], ["the", "dog_house", "over"]])
def test_bm25_equals_full_text_engine(spark, query):
    df = spark.createDataFrame(list(enumerate(DOCS)), "id int, x string")
    got = {r.id: r.bm25_score for r in sparse.bm25(df, query, "id", "x").collect()}
    want = fts(query)
    assert got.keys() == want.keys()
    index = sparse.build_postings(df, "id", "x", None)
    by_index = {int(r.chunk_id): r.bm25_score for r in sparse.bm25_from_postings(index, query).collect()}
    # documents without terms are not in the index, so its corpus is smaller by one
    assert by_index.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-9)


def test_phrase_overlaps_and_nulls(spark):
    df = spark.createDataFrame([(1, "a a a"), (2, None)], "id int, x string")
    assert [r.id for r in sparse.bm25(df, ["a"], "id", "x").collect()] == [1]
    assert sparse.corpus_stats(df, "x").first().n_docs == 2


def test_dense_matches_numpy(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((60, 8)).astype(np.float32)
    rows = [(i, m[i].tolist()) for i in range(60)] + [(60, None), (61, [0.0] * 8), (62, [1.0] * 3), (63, m[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    q = df.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = dense.top_k_multi(df, q, 5).orderBy("query_id", "rank").collect()
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    for query in (0, 20, 40):
        mine = [r.vec_id for r in got if r.query_id == query]
        want = sorted(((-round(float(u[query].astype(float) @ u[i].astype(float)), 6), i) for i in range(60) if i != query))
        if query == 0:
            assert mine[0] == 63
        else:
            assert len(set(mine) & {i for _, i in want[:6]} | ({63} & set(mine))) == 5
    top = dense.top_k(df, m[0].tolist(), 2, "vec_id").collect()
    assert [r.vec_id for r in top] == [0, 63] and top[0].score == pytest.approx(1)
    assert dense.top_k_multi(df, q.limit(0), 5).count() == 0


def test_lsh(spark):
    m = np.eye(6, dtype=np.float32)
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(6)], "vec_id int, embedding array<float>")
    model, rows = lsh.fit(df)
    assert lsh.approximate_top_k(model, rows, m[2].tolist(), 1, "vec_id").first().vec_id == 2


def test_rrf_order_and_labels(spark):
    d = spark.createDataFrame([("x", 0.9, 1), ("y", 0.8, 2)], "chunk_id string, score double, rank int")
    s = spark.createDataFrame([("y", -3.0, 1), ("z", -2.0, 2)], "chunk_id string, bm25_score double, rank int")
    got = fusion.rrf(d, s, 10).orderBy("fused_rank").collect()
    assert [(r.chunk_id, r.source) for r in got] == [("y", "both"), ("x", "dense"), ("z", "sparse")]
    assert got[0].hybrid_score == pytest.approx(1 / 62 + 1 / 61)
    assert fusion.rrf(d.limit(0), s.limit(0), 10).count() == 0


def test_regex_and_rerank(spark):
    hits = spark.createDataFrame([("a", "Foo bar", 1), ("b", None, 2), ("c", "foo", 3)], "chunk_id string, content string, fused_rank int")
    assert [r.chunk_id for r in fusion.regex_filter(hits, "^foo").collect()] == ["a", "c"]
    with pytest.raises(ValueError):
        fusion.regex_filter(hits, "(")
    score = F.when(F.col("chunk_id") == "a", float("nan")).when(F.col("chunk_id") == "b", 2.0)
    got = fusion.order_reranked(hits, 2, score).orderBy("final_rank").collect()
    assert [r.chunk_id for r in got] == ["b", "a", "c"] and got[2].rerank_score is None


def test_reranker_limits():
    assert rerank.rerank(rerank.NeutralReranker(), "q", ["a", "b"]) == [0, 0]
    assert rerank.rerank(rerank.OverlapReranker(), "parse token", ["parse the token", "x"])[0] > 0

    class Slow:
        def score(self, query, documents):
            import time

            time.sleep(0.05)
            return [float("nan")] * len(documents)

    assert rerank.rerank(Slow(), "q", ["a"]) == [0.0]
    with pytest.raises(rerank.RerankTimeout):
        rerank.rerank(Slow(), "q", ["a"] * 5, timeout_ms=60)
    assert [rerank.batch_size(n) for n in (5, 12, 13)] == [1, 2, 4] and rerank.head_size(50, 5) == 12 and rerank.budget_ms(1) == 500


def test_embedder():
    e = embed.HashEmbedder(64)
    v = embed.embed_texts(e, ["alpha beta", "", "alpha beta", "gamma " * 5000, None])
    assert np.allclose(np.linalg.norm(v, axis=1), [1, 0, 1, 1, 0], atol=1e-5) and np.allclose(v[0], v[2])
    assert np.allclose(embed.embed_texts(e, ["alpha beta"])[0], v[0]) and embed.embed_text(e, " ") == []

    class Small(embed.HashEmbedder):
        def embed(self, batch):
            if len(batch) > 1:
                raise MemoryError
            return super().embed(batch)

    assert np.allclose(embed.embed_texts(Small(64), ["alpha beta", "delta"])[0], v[0])
    assert embed.model_billions("org/x-0.6B-4bit") == 0.6 and embed.batch_size_for(8) == 2 and embed.batch_size_for(None, 1600) == 8


@given(st.lists(st.integers(1, 50), max_size=40), st.integers(1, 6), st.integers(10, 120))
@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_batches_hold_their_limits(lengths, items, tokens):
    batches = embed.plan_batches(lengths, items, tokens)
    assert sorted(i for b in batches for i in b) == list(range(len(lengths)))
    for b in batches:
        assert len(b) <= items and (len(b) == 1 or len(b) * max(lengths[i] for i in b) <= tokens)


def test_batch_column_equals_planner(spark):
    lengths = [3, 9, 1, 1, 20, 7, 7, 2]
    df = spark.createDataFrame([([(n, i) for i, n in enumerate(lengths)],)], "l array<struct<length:int,id:bigint>>")
    got = {x.id: x.batch for x in df.select(embed.batch_plan_col(F.col("l"), 3, 20).alias("b")).first().b}
    assert got == {i: n for n, b in enumerate(embed.plan_batches(lengths, 3, 20)) for i in b}


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", "d1", 2), ("q", "d2", 1), ("q", "d3", 3), ("q", "d3", 3)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "d1", 3.0), ("q", "d3", 2.0), ("p", "d9", 1.0), ("q", "d2", 0.0)], "query_id string, doc_id string, rel double")
    got = {r.query_id: r for r in metrics.evaluate(ranked, qrels).collect()}
    assert got["q"].mrr == 0.5 and got["q"].recall == 1 and (got["p"].mrr, got["p"].recall, got["p"].ndcg) == (0, 0, 0)
    dcg, best = 7 / np.log2(3) + 3 / np.log2(4), 7 + 3 / np.log2(3)
    assert got["q"].ndcg == pytest.approx(dcg / best)
    assert metrics.macro_average(metrics.evaluate(ranked, qrels)).first().mrr == 0.25
    runs = spark.createDataFrame([("a", 2.0, 10), ("a", 4.0, 10), ("b", 0.0, 1)], "name string, seconds double, items bigint")
    assert {r.name: r.items_per_s for r in metrics.run_summary(runs).collect()} == {"a": pytest.approx(20 / 6), "b": None}
    assert [r.name for r in metrics.leaderboard(spark.createDataFrame([("x", 1.0), ("y", 2.0)], "name string, v double"), ["v"]).orderBy("place").collect()] == ["y", "x"]


def test_query_tokens_used(spark):
    assert query_tokens("ApplyDiscount")[0] == "applydiscount"
