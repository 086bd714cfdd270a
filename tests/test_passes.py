"""Rankings and phrases found where the documents are read, against brute force."""

import math
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from corvid.operators import lexical, passes
from corvid.plans import measures
from tests.test_search import WORDS, bm25, corpus


def test_bm25_moves_no_words(spark, tmp_path):
    spark.createDataFrame(corpus(1), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    queries = spark.createDataFrame([(0, "agua ley"), (1, "plan pago obra")], "item_id long, text string")
    got = lexical.bm25(docs, queries, "item_id", 5)
    rows = got.collect()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert rows and "hashpartitioning(item_id" in plan and "Join" not in plan and "hashpartitioning(term" not in plan and "hashpartitioning(doc_id" not in plan


def test_bm25_by_parts_of_the_queries(spark, monkeypatch):
    docs = [(i, t) for i, t in corpus(7)] + [(100 + i, "agua salud") for i in range(9)]
    queries = [(q, " ".join(random.Random(q).sample(WORDS, 2))) for q in range(6)]
    frame, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    monkeypatch.setattr(lexical, "TAKEN", 4)
    got = lexical.bm25(frame, asked, "item_id", 4).collect()
    for q, text in queries:
        assert [r["doc_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["item_id"] == q] == bm25(docs, text, 4)


def test_best_keeps_ties_by_id(monkeypatch):
    monkeypatch.setattr(passes, "CELLS", 40)
    monkeypatch.setattr(passes, "TOKENS", 10)
    r = np.random.default_rng(3)
    texts = [[f"w{x}" for x in r.integers(0, 6, r.integers(0, 5))] for _ in range(300)]
    ids = r.permutation(300)
    terms, worth, starts, asking, weights = pa.array(["w0", "w1", "w2"]), np.array([1.5, 0.7, 1e-6]), np.array([0, 2, 3, 4]), np.array([0, 1, 1, 2]), np.array([1, 2, 1, 1])
    batches = [pa.record_batch([pa.array(ids[i : i + 70]), pa.array(texts[i : i + 70], pa.list_(pa.string()))], names=["id", "tokens"]) for i in range(0, 300, 70)]
    avg = sum(map(len, texts)) / 300
    got = pa.Table.from_batches(passes.best(terms, worth, starts, asking, weights, pa.array(["a", "b", "c"]), avg, 7, 1.2, 0.75, ("q", "id"))(iter(batches)))
    for q, wanted in {"a": {0: 1}, "b": {0: 2, 1: 1}, "c": {2: 1}}.items():
        want = []
        for i, t in zip(ids.tolist(), texts, strict=True):
            tf = {w: t.count(f"w{w}") for w in wanted}
            if any(tf.values()):
                want.append((-round(sum(n * worth[w] * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / avg)) for w, n in wanted.items()), 6), i))
        mine = [(-x["score"], x["id"]) for x in got.to_pylist() if x["q"] == q]
        assert mine == sorted(want)[:7]


def test_rounding_is_sparks(spark):
    from pyspark.sql import functions as F

    values = [0.0000005, 1.0000015, 2.5000025, 1.23456749999, 123.4565435, 0.1 + 0.2, 7.0000005, 1e-9]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(F.round("v", 6)).collect()]
    assert passes.rounded(np.array(values)).tolist() == want


def test_phrases_move_no_text(spark, tmp_path):
    spark.createDataFrame(corpus(2), "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    phrases = spark.createDataFrame([(0, ["agua", "ley"]), (1, ["agua", "ley"]), (2, ["plan"])], "q long, words array<string>")
    hits = lexical.phrase_hits(docs, phrases, "q")
    rows = hits.collect()
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert rows and "SortMergeJoin" not in plan and "hashpartitioning(gram" not in plan
    assert sorted(r["doc_id"] for r in rows if r["q"] == 0) == sorted(r["doc_id"] for r in rows if r["q"] == 1)


@pytest.mark.parametrize("seed", range(3))
def test_phrases_are_followed_word_by_word(seed):
    r = random.Random(seed)
    texts = [[r.choice("abc") for _ in range(r.randint(0, 30))] for _ in range(40)]
    phrases = [[r.choice("abcx") for _ in range(r.randint(1, 6))] for _ in range(60)] + [["a"], ["a"], ["b", "c"]]
    trie = passes.Trie(pa.array(phrases, pa.list_(pa.string())))
    assert all((trie.phrase[i] == trie.phrase[j]) == (phrases[i] == phrases[j]) for i in range(63) for j in range(63))
    batch = pa.record_batch([pa.array(range(40)), pa.array(texts, pa.list_(pa.string()))], names=["id", "tokens"])
    got = {(x["id"], x["n"]): x["hits"] for x in pa.Table.from_batches(list(passes.phrases(trie, ("n", "id"))(iter([batch.slice(0, 15), batch.slice(15)])))).to_pylist()}
    want = {}
    for d, t in enumerate(texts):
        for i, p in enumerate(phrases):
            if n := sum(t[k : k + len(p)] == p for k in range(len(t) - len(p) + 1)):
                want[d, int(trie.phrase[i])] = n
    assert got == want


def test_more_phrases_than_are_taken_along(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in corpus(4)], "doc_id long, text string")
    phrases = spark.createDataFrame([(0, ["agua", "ley"]), (1, ["agua"]), (2, ["plan", "obra", "pago"])], "q long, words array<string>")
    want = [sorted(map(tuple, f(docs, phrases, "q").collect())) for f in (lexical.phrase_hits, lexical.phrase_bm25)]
    monkeypatch.setattr(lexical, "PHRASE_WORDS", 2)
    assert want == [sorted(map(tuple, f(docs, phrases, "q").collect())) for f in (lexical.phrase_hits, lexical.phrase_bm25)]


def few_lines(spark, folder):
    """Documents of several lines, one of which is a passage; passages as queries."""
    passages = [(q, " ".join(random.Random(q).choices(WORDS, k=9))) for q in range(12)]
    docs = [(i, f"{t}\n{passages[i % 12][1]}\n{t}") for i, t in corpus(5)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(passages, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, passages


def moved(df):
    """What the plan's exchanges are dealt by, once it has run."""
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString()))


def test_evidence_recall_moves_no_words(spark, tmp_path):
    docs, passages = few_lines(spark, tmp_path)
    got = measures.evidence_recall(spark, str(tmp_path))
    row = got.first()
    lines = [(d * 100000 + i, line) for d, t in docs for i, line in enumerate(t.split("\n"))]
    shares = []
    for _, text in passages:
        gold = {c for c, line in lines if line == text}
        best = bm25(lines, text, 30)
        shares.append([len(gold & set(best[:k])) / len(gold) for k in (5, 10, 20)])
    assert row["n"] == 12 and [row[f"evidence_{k}"] for k in (5, 10, 20)] == pytest.approx(np.mean(shares, axis=0), abs=2e-6)
    assert moved(got) and not [x for x in moved(got) if re.search("term|gram|tokens|words", x)]


def test_full_depth_mrr_moves_no_words(spark, tmp_path):
    docs, passages = few_lines(spark, tmp_path)
    got = measures.full_depth_mrr(spark, str(tmp_path))
    rows = {r["category"]: r for r in got.collect()}
    lines = [(d * 100000 + i, line) for d, t in docs for i, line in enumerate(t.split("\n"))]
    first = {}
    for q, text in passages:
        ranks = [i for i, c in enumerate(bm25(lines, text, 200), 1) if dict(lines)[c] == text]
        first[q] = 1 / ranks[0] if ranks else 0.0
    for category in (None, "c0", "c1", "c2"):
        of = [v for q, v in first.items() if category in (None, f"c{q % 3}")]
        r = rows[category]
        assert (r["n"], r["mrr"], r["found"]) == (len(of), pytest.approx(np.mean(of), abs=2e-6), pytest.approx(np.mean([v > 0 for v in of]), abs=2e-6))
    assert len(rows) == 4 and moved(got) and not [x for x in moved(got) if re.search("term|gram|tokens|words", x)]


def test_shared_phrases_are_told_apart_where_documents_are_read(spark, tmp_path):
    docs = [(i, f"ley agua norma {t}" if i % 2 else t) for i, t in corpus(6)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/docs")
    asked = [(q, "ley agua norma".split()) for q in range(30)] + [(30, ["plan", "obra"]), (31, ["nada"]), (32, [])]
    got = lexical.phrase_bm25(spark.read.parquet(f"{tmp_path}/docs"), spark.createDataFrame(asked, "q long, words array<string>"), "q")
    rows = {(r["q"], r["doc_id"]): (r["hits"], r["score"]) for r in got.collect()}
    avg, want = sum(len(t.split()) for _, t in docs) / len(docs), {}
    for q, words in asked:
        hits = {d: n for d, t in docs if words and (n := sum(t.split()[k : k + len(words)] == words for k in range(len(t.split()))))}
        idf = math.log((len(docs) - len(hits) + 0.5) / (len(hits) + 0.5))
        for d, n in hits.items():
            want[q, d] = (n, pytest.approx((idf if idf > 0 else 1e-6) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(dict(docs)[d].split()) / avg)), abs=1e-6))
    assert rows == want and len(rows) >= 600 and not moved(got)


def one_file(spark, folder):
    """The tables of ``few_lines`` with the documents in a single file that has a row group for every core, and a name that URIs escape."""
    few_lines(spark, folder)
    docs = pq.read_table(f"{folder}/documents.parquet")
    (folder / "a b").mkdir()
    (folder / "a b/documents.parquet").mkdir()
    pq.write_table(docs, folder / "a b/documents.parquet/one%20file.parquet", row_group_size=5)
    (folder / "benchmark.parquet").rename(folder / "a b/benchmark.parquet")
    return str(folder / "a b")


def test_evidence_recall_leaves_row_groups_where_they_are(spark, tmp_path):
    got = measures.evidence_recall(spark, one_file(spark, tmp_path))
    assert got.first()["n"] == 12 and "RoundRobin" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_file_of_one_row_group_is_still_dealt_out(spark, tmp_path):
    pq.write_table(pa.table({"doc_id": [1, 2], "text": ["a", "b"]}), tmp_path / "docs.parquet")
    (tmp_path / "docs.json").write_text('{"doc_id": 1, "text": "a"}\n')
    for docs in (spark.read.parquet(f"{tmp_path}/docs.parquet"), spark.read.json(f"{tmp_path}/docs.json")):
        assert lexical.readable_parts(docs) == 1
        assert "RoundRobin" in lexical.spread(docs)._jdf.queryExecution().executedPlan().toString()


def test_full_depth_mrr_leaves_row_groups_where_they_are(spark, tmp_path):
    got = measures.full_depth_mrr(spark, one_file(spark, tmp_path))
    assert {r["category"]: r["n"] for r in got.collect()}[None] == 12 and "RoundRobin" not in got._jdf.queryExecution().executedPlan().toString()
