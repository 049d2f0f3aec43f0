import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.llm import garbled, leakage, mixing, neighbours

DOCS = "doc_id bigint, text string, source string, n_chars bigint"


# mixing
def mix_frames(spark):
    rng = random.Random(3)
    docs = [(i, "x" * 5, rng.choice(["a", "a", "a", " B ", "c", None, ""]), rng.choice([0, 3, 40, 400, None])) for i in range(3000)]
    targets = [(1, "a", 5.0, 3, 0.5), (1, "b", 5.0, 4, 0.5), (2, "a", 1.0, 1, 3.0), (2, "c", 1.0, 2, 3.0), (2, "none", 1.0, 5, 3.0), (3, "a", None, 2, 1.0), (3, "c", float("nan"), 2, 1.0), (1, "b", 5.0, 4, 0.5)]
    return spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS tokens", "'z' AS block"), spark.createDataFrame(targets, "mix_id bigint, source string, weight double, max_repeats int, budget_share double"), docs


def tokens_of(d):
    return max(1, (d[3] if d[3] is not None else len(d[1])) // 4)


def test_plan_and_sample(spark):
    docs, targets, rows = mix_frames(spark)
    plan = {(r.mix_id, r.source): r for r in mixing.plan_mix(docs, targets).collect()}
    total = sum(map(tokens_of, rows))
    of = lambda s: sum(tokens_of(d) for d in rows if (d[2] or "").strip().lower() == s)
    assert len(plan) == 7
    assert plan[1, "a"].source_tokens == of("a") and plan[1, "b"].want_tokens == pytest.approx(0.25 * total)
    assert plan[1, "b"].reachable == (of("b") * 4 >= 0.25 * total) and plan[2, "none"].reachable is False and plan[2, "none"].planned_tokens == 0
    assert plan[2, "a"].reachable is False and plan[3, "a"].reachable and plan[3, "a"].planned_tokens == 0
    report = {(r.mix_id, r.source): r for r in mixing.mix_report(docs, targets).collect()}
    biggest = max(map(tokens_of, rows))
    for k, p in plan.items():
        assert abs(report[k].chosen_tokens - p.planned_tokens) <= biggest
        assert report[k].repeats <= p.max_repeats + 1e-9 or p.planned_tokens == 0
    used = {}
    for r in mixing.sample_mix(docs, targets).collect():
        used.setdefault((r.mix_id, r.source, r.doc_id), []).append(r.block)
    assert all(len(b) == len(set(b)) for b in used.values())
    again = sorted(map(tuple, mixing.sample_mix(docs, targets).collect()))
    assert again == sorted(map(tuple, mixing.sample_mix(docs.repartition(7), targets).collect()))
    assert mixing.sample_mix(docs.limit(0), targets).count() == 0 and mixing.plan_mix(docs, targets.limit(0)).count() == 0


def test_exponent_meets_entropy(spark):
    totals = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10), (None, 5)], "source string, tokens bigint")
    q = {r.source: r.share for r in mixing.temperature_shares(totals, 1.0).collect()}
    assert -sum(p * math.log(p) for p in q.values()) == pytest.approx(1.0, abs=1e-6) and q["a"] > q["b"] > q["c"]
    assert {round(r.share, 6) for r in mixing.temperature_shares(totals, 9.0).collect()} == {round(1 / 3, 6)}


def test_reachable_from_the_exponent(spark):
    docs, targets, rows = mix_frames(spark)
    for p in mixing.plan_mix(docs, targets).collect():
        assert p.reachable == (p.cap_tokens >= p.want_tokens) == (p.source_alpha == 1.0) and p.source_alpha >= p.alpha - 1e-9 or p.source_tokens == 0


def test_sizes_by_a_tokenizer(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no vocabulary files")
    docs, targets, rows = mix_frames(spark)
    from tokenizers import Tokenizer

    n = len(Tokenizer.from_file(path).encode("xxxxx", add_special_tokens=False).ids)
    totals = {r.source: (r.docs, r.tokens) for r in mixing.source_totals(docs, mixing.tokenizer_tokens(F.col("text"), path)).collect()}
    assert all(tokens == n * count for count, tokens in totals.values())


# leakage
def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(60)] + ["der", "é", "数", "x_y"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([5, 12, 30, 80])))) for i in range(40)] + [(90, None), (91, ""), (92, items_text := "A-b, " * 20)]
    docs = []
    for i in range(120):
        words = rng.choices(vocab, k=rng.choice([0, 8, 100, 700]))
        if i % 3 == 0:
            t = leakage.words(rng.choice(items[:40])[1])
            n = rng.choice([11, 12, 13, len(t)])
            at, start = rng.randrange(len(words) + 1), rng.randrange(max(1, len(t) - n + 1))
            words[at:at] = t[start : start + n]
        docs.append((i, rng.choice([" ", ", ", "\n_"]).join(words).upper()))
    docs += [(200, None), (201, items_text), (201, items_text), (None, items_text)]
    grams = lambda t: {tuple(w[i : i + 12]) for w in [leakage.words(t)] for i in range(len(w) - 11)}
    want = {(d, i) for d, t in docs for i, s in items if d is not None and t and s and grams(t) & grams(s)}
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'c' AS item_id")
    it = spark.createDataFrame([*items, items[0]], "item_id bigint, text string").selectExpr("*", "'s' AS suite", "7 AS doc_id")
    got = leakage.leaked_items(df, it)
    assert len(want) > 15 and sorted(map(tuple, got.collect())) == sorted(want)
    assert sorted(map(tuple, leakage.joined_leaks(df.filter("doc_id IS NOT NULL AND text IS NOT NULL"), it.dropna().distinct()).collect())) == sorted(want)
    assert leakage.leaked_items(df, it.limit(0)).count() == 0 and leakage.leaked_items(df.limit(0), it).count() == 0
    assert {r.item_id: r.documents for r in leakage.leak_report(df, it).collect()}[92] == 1


def test_retrieval_keeps_the_threshold():
    rng = random.Random(6)
    items = [(i, " ".join(rng.choices([f"t{j}" for j in range(30)], k=25))) for i in range(60)]
    index = leakage.ItemIndex(items)
    for _ in range(200):
        terms = set(rng.sample(range(len(index.vocab)), 14))
        scores = {}
        for t in terms:
            for d, s in zip(*index.terms[t][:2]):
                scores[d] = scores.get(d, 0) + s
        assert sorted(index.retrieve(terms)) == sorted(d for d, s in scores.items() if s >= 1)


def test_several_indexes(spark, monkeypatch):
    text = " ".join(f"word{i}" for i in range(40))
    it = spark.createDataFrame([(i, f"{i} {text}") for i in range(9)], "item_id bigint, text string")
    monkeypatch.setattr(leakage, "INDEX_CHARS", 700)
    assert leakage.leaked_items(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), it).count() == 9


# neighbours
def clustered(seed, n=1500, dim=32):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n // 3, dim))
    return np.concatenate([base, base[: n // 6] + 0.25 * rng.standard_normal((n // 6, dim)), rng.standard_normal((n // 2, dim))]).astype(np.float32)


def mutual_truth(ids, m, k=10, least=0.9):
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -2)
    order = np.argsort(ids)
    s, ids = s[order][:, order], np.array(ids)[order]
    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
    near = np.zeros_like(s, bool)
    np.put_along_axis(near, top, True, 1)
    return {(int(ids[i]), int(ids[j])) for i, j in zip(*np.nonzero(np.triu(near & near.T & (s >= least))))}


def test_mutual_neighbours_recall(spark):
    m = clustered(1)
    ids = np.random.default_rng(2).permutation(len(m)).tolist()
    rows = [(int(i), v.tolist()) for i, v in zip(ids, m)] + [(5000, None), (5001, [0.0] * 32), (5002, []), (5003, [float("nan")] * 32), (None, [1.0] * 32), (5004, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 AS id", "2 AS unit", "3 AS dim")
    got = set(map(tuple, neighbours.mutual_pairs(df).collect()))
    want = mutual_truth(ids, m)
    assert got <= want and len(got) >= 0.98 * len(want) > 100
    assert neighbours.mutual_pairs(df.limit(0)).count() == 0


def test_cuts_and_tasks_lose_no_pair(spark, monkeypatch):
    m = clustered(7, 3000, 24)
    m[:900] = m[0] + 0.02 * np.random.default_rng(8).standard_normal((900, 24)).astype(np.float32)  # nearly one direction: long equal strings
    ids = np.random.default_rng(9).permutation(len(m)).tolist()
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, m)], "vec_id bigint, embedding array<float>")
    want = mutual_truth(ids[900:], m[900:])
    got = []
    for rows, parts in ((10**6, 8), (300, 8), (300, 100)):
        monkeypatch.setattr(neighbours, "ROWS", rows)
        pairs = {(r.a, r.b) for r in neighbours.similar_pairs(df, partitions=parts)[0].collect()}
        got.append(pairs)
        assert want <= pairs | {p for p in want if p not in pairs and len(want - pairs) <= 0.01 * len(want)}
    assert got[1] == got[2] and len(got[0] ^ got[1]) <= 0.02 * len(got[0])


def test_levels_hold_the_target():
    rng = np.random.default_rng(3)
    u = rng.standard_normal((2000, 16)).astype(np.float32)
    f = neighbours.Forest(np.arange(2000), u, 2000, 6, 120, 48)
    strings = neighbours._strings(u, 16, 6)
    levels = f.levels(strings)

    def held(i, level):
        return sum(int((strings[:, t] >> np.uint64(64 - level) == strings[i, t] >> np.uint64(64 - level)).sum()) if level else 2000 for t in range(6))

    for i in range(0, 2000, 97):
        assert held(i, int(levels[i])) >= 126 and (levels[i] == 64 or held(i, int(levels[i]) + 1) < 126)


def test_hot_copies(spark):
    v, w = [1.0, 2.0, 3.0, 4.0], [4.0, -3.0, 2.0, -1.0]
    df = spark.range(3000).selectExpr("id AS vec_id", f"CASE WHEN id % 3 = 0 THEN array({','.join(map(str, w))}) ELSE array({','.join(map(str, v))}) END AS embedding")
    got = set(map(tuple, neighbours.mutual_pairs(df).collect()))
    first = lambda c: [i for i in range(3000) if (i % 3 == 0) == c][:11]
    # of a class of copies, the first eleven by id: each has the other ten nearest
    assert got == {p for c in (True, False) for p in itertools.combinations(first(c), 2)}
    pairs, members = neighbours.similar_pairs(df)
    assert pairs.count() == 0 and {(r.rep, r.copies) for r in members.select("rep", "copies").distinct().collect()} == {(0, 1000), (1, 2000)}


# encodings
TEXTS = {
    "fr": "Cette année, l'été a été très agréable à la forêt, déjà près de l'hôtel", "de": "Die Prüfung läuft über größere Maße für schöne Straßen", "es": "La función está aquí y mañana también habrá más años",
    "ru": "Это простой текст на русском языке для проверки кодировки", "zh": "这是一个用来检查编码的简单文本", "en": "It’s a “quoted” word — naïve, but fine…",
}
CHAINS = [("fr", "utf-8", "cp1252", 1), ("de", "utf-8", "latin-1", 1), ("es", "utf-8", "cp850", 1), ("en", "utf-8", "cp1252", 1), ("fr", "utf-8", "mac-roman", 1), ("ru", "cp1251", "cp1252", 1), ("ru", "koi8-r", "cp1251", 1), ("es", "utf-8", "cp1252", 2), ("zh", "gb18030", "latin-1", 1)]


def break_text(text, true, wrong, times):
    for _ in range(times):
        raw = text.encode(true)
        text = "".join(garbled._table(wrong) and (bytes([b]).decode(wrong, "ignore") or chr(b)) for b in raw)
    return text


def corpus(spark):
    rows = [(n, f"{TEXTS[k]} {TEXTS[j]}", "wiki") for n, (k, j) in enumerate(itertools.product(TEXTS, TEXTS))] * 1
    rows = [(i + 100 * r, t, s) for r in range(12) for i, t, s in rows]
    bad = {9000 + n: (TEXTS[k], break_text(TEXTS[k], t, w, x)) for n, (k, t, w, x) in enumerate(CHAINS)}
    extra = [(8000, "Samples `Ã©` and `â€™` are quoted here, été", "wiki"), (8001, "plain ascii", None), (8002, None, "wiki"), (8003, "", ""), (None, "Ã©tÃ©", "wiki"), (8004, "lost �t� here, tr�s", "wiki")]
    return spark.createDataFrame(rows + [(i, b, "wiki") for i, (_, b) in bad.items()] + extra, "doc_id bigint, text string, source string").selectExpr("*", "'c' AS chain", "1 AS row"), bad


def test_chains_are_found_and_undone(spark):
    df, bad = corpus(spark)
    found = {r.doc_id for r in garbled.garbled_documents(df).collect()}
    assert found == {*bad, 8004}
    fixed = {r.doc_id: r for r in garbled.repaired_documents(df).collect()}
    good = sum(fixed[i].repaired == text for i, (text, _) in bad.items())
    assert good >= len(bad) - 1 and not fixed[8004].restorable
    assert garbled.garbled_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("lang,true,wrong,times", CHAINS)
def test_undo_is_the_inverse(lang, true, wrong, times):
    name = "+".join([f"{true}>{wrong}"] * times)
    for token in garbled.tokens_of(break_text(TEXTS[lang], true, wrong, times)):
        assert garbled.undo(token, name) in garbled.tokens_of(TEXTS[lang])


@pytest.mark.parametrize("steps", [("cp1252", "latin-1"), ("latin-1", "cp437"), ("cp437", "cp437", "cp437")])
def test_steps_of_different_encodings(steps):
    text = TEXTS["fr"]
    for wrong in steps:
        text = break_text(text, "utf-8", wrong, 1)
    chain = "+".join(f"utf-8>{w}" for w in reversed(steps))
    for token, plain in zip(text.split(" "), TEXTS["fr"].split(" ")):
        if not plain.isascii():
            assert (chain, plain) in garbled.chains_of(token) and garbled.undo(token, chain) == plain


def test_fields_and_sources_are_pooled_apart(spark, monkeypatch):
    monkeypatch.setattr(garbled, "MAX_SOURCES", 2)
    df, bad = corpus(spark)
    df = df.selectExpr("doc_id", "text", "source", "CASE WHEN doc_id >= 9000 THEN 'plain title' ELSE text END AS title")
    df = df.unionByName(df.filter("doc_id < 100").selectExpr("doc_id + 20000 AS doc_id", "text", "CASE WHEN doc_id % 2 = 0 THEN 'small' END AS source", "title"))
    got = garbled.garbled_documents(df, ("text", "title")).collect()
    assert {r.doc_id for r in got if r.field == "text"} == {*bad, 8004} and {r.doc_id for r in got if r.field == "title"} == {8004}


def test_all_pairs_are_in_the_model(spark, monkeypatch):
    df, bad = corpus(spark)
    held = garbled._model(df)
    want = {(r.doc_id, r.chain, r.repaired) for r in garbled.repaired_documents(df).collect()}
    monkeypatch.setattr(garbled, "MAX_PAIRS", 50)
    filed = garbled._model(df)
    assert isinstance(filed.pairs, garbled.PairFile) and filed.pairs.size == len(held.pairs) > 50
    assert (filed.left, filed.right, filed.total) == (held.left, held.right, held.total)
    assert all(filed.pairs.get(k) == n for k, n in held.pairs.items()) and filed.pairs.get(("\U0001f000", "é")) == 0
    assert all(filed.cost(t) == held.cost(t) for _, x in bad.values() for t in garbled.tokens_of(x))
    assert {(r.doc_id, r.chain, r.repaired) for r in garbled.repaired_documents(df).collect()} == want


def test_every_source_has_its_own_prior(spark, monkeypatch):
    df, _ = corpus(spark)
    df = df.selectExpr("doc_id", "text", "CASE WHEN doc_id >= 9000 THEN concat('s', doc_id % 4) ELSE concat('t', doc_id % 5) END AS source")
    key = lambda r: (str(r.doc_id), r.field, r.source, r.row, r.chain)
    want = {key(r): r.clean for r in garbled.judged(df).collect()}
    monkeypatch.setattr(garbled, "MAX_SOURCES", 2)
    got = {key(r): r.clean for r in garbled.judged(df).collect()}
    assert want and got == pytest.approx(want, abs=1e-9)
    assert garbled.judged(df.limit(0)).count() == 0


def test_neighbours_without_a_bar(spark):
    m = np.random.default_rng(5).standard_normal((600, 32))
    m[1] = m[0]
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(600, None), (601, [0.0] * 32)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r for r in neighbours.nearest_neighbours(df, 10).collect()}
    cos = unit @ unit.T
    np.fill_diagonal(cos, -2)
    top = [set(np.argsort(-row)[:10].tolist()) for row in cos]
    assert sorted(got) == list(range(600)) and all(len(r.neighbours) == 10 and r.vec_id not in r.neighbours for r in got.values())
    assert sum(len(top[i] & set(got[i].neighbours)) for i in range(600)) >= 0.95 * 6000 and np.sort(cos, axis=1)[:, -10].max() < 0.9
    assert got[0].neighbours[0] == 1 and got[1].neighbours[0] == 0
