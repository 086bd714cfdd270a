"""The two-stage search against small programs that follow the formulas."""

import math
import random
from collections import Counter

from corvid.operators import evaluate, lexical, search

WORDS = "agua ley norma salud presupuesto decreto acuerdo plan obra pago".split()


def corpus(seed, n=40):
    r = random.Random(seed)
    return [(i, " ".join(r.choice(WORDS) for _ in range(r.randint(1, 40)))) for i in range(n)]


def bm25(docs, query, k):
    words = {i: t.split() for i, t in docs}
    avg = sum(map(len, words.values())) / len(words)
    terms = [(t, sum(t in w for w in words.values())) for t in dict.fromkeys(query.split())]
    kept = [x for x in terms if x[1] <= int(len(words) * 0.5)] or terms
    out = {}
    for i, w in words.items():
        c = Counter(w)
        s = 0.0
        for t, df in kept:
            idf = math.log((len(words) - df + 0.5) / (df + 0.5))
            s += (idf if idf > 0 else 1e-6) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(w) / avg)) if c[t] else 0.0
        if any(c[t] for t, _ in kept):
            out[i] = round(s, 6)
    return sorted(out, key=lambda i: (-out[i], i))[:k]


def test_bm25_follows_the_formula(spark):
    for seed in range(3):
        docs = corpus(seed)
        queries = [(q, " ".join(random.Random(100 + seed * 10 + q).sample(WORDS, 3))) for q in range(4)]
        got = lexical.bm25(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string"), "item_id", 8).orderBy("item_id", "rank").collect()
        for q, text in queries:
            assert [r["doc_id"] for r in got if r["item_id"] == q] == bm25(docs, text, 8)


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1), (2, 21, 3), (3, 30, 1)], "q int, i int, rank int")
    gold = spark.createDataFrame([(1, 11, "a"), (2, 20, "b"), (2, 21, "b"), (3, 99, "b")], "q int, i int, category string")
    first = evaluate.first_ranks(ranked, gold, "q", "i")
    rows = {r["category"]: r for r in evaluate.single_gold(first, by="category").collect()}
    assert rows["a"]["mrr"] == 0.5 and rows[None]["n"] == 3 and rows[None]["recall_1"] == round(1 / 3, 6)
    m = evaluate.multi_summary(evaluate.multi_gold(ranked, gold, "q", "i", (1, 5)), (1, 5)).first()
    assert m["all_5"] == round(2 / 3, 6) and m["recall_1"] == round((0 + 0.5 + 0) / 3, 6)


def test_document_search_boosts_titles_and_filters(spark):
    docs = spark.createDataFrame([(1, "cita la NOM-001-SSA-2010 agua"), (2, "NOM-001-SSA-2010 agua potable texto largo de la norma"), (3, "otra cosa"), (4, "mas texto"), (5, "nada")], "doc_id long, text string")
    meta = spark.createDataFrame([(i, f"202{i}-01-01", "MAT") for i in range(1, 6)], "doc_id long, d string, section string").selectExpr("doc_id", "CAST(d AS DATE) AS publication_date", "section")
    titles = spark.createDataFrame([(1, "Acuerdo cualquiera"), (2, "Norma Oficial Mexicana NOM-001-SSA-2010, agua")], "doc_id long, title string")
    queries = spark.createDataFrame([(0, "requisitos de la NOM-001-SSA-2010 agua")], "query_id long, text string")
    got = search.documents(docs, queries, meta, titles=titles).orderBy("rank").collect()
    assert got[0]["doc_id"] == 2 and got[0]["title_boost"] == 188.0
    late = search.documents(docs, queries, meta, search.Filters(as_of="2021-06-01"), titles=titles).collect()
    assert {r["doc_id"] for r in late} == {1}
    recent = search.documents(docs, queries, meta, prefer_recent=True).orderBy("rank").collect()
    assert any(r["recency_boost"] > 0 for r in recent)


def test_document_search_plans_each_step_once(spark):
    docs = spark.createDataFrame([(i, f"la NOM-00{i}-SSA-2010 agua {i}") for i in range(5)], "doc_id long, text string")
    meta = docs.selectExpr("doc_id", "DATE '2020-01-01' AS publication_date", "'MAT' AS section")
    queries = spark.createDataFrame([(0, "requisitos de la NOM-001-SSA-2010 agua")], "query_id long, text string")
    hits = spark.createDataFrame([(0, 3, 0.9, 1), (0, 4, 0.8, 2)], "query_id long, doc_id long, score double, rank int")
    got = search.documents(docs, queries, meta, vector_hits=hits, titles=docs.selectExpr("doc_id", "text AS title"), prefer_recent=True)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" not in plan
    assert got.orderBy("rank").first()["doc_id"] == 1
