"""The persisted index, candidates and bonuses, blocks of vectors, recipes and other chunks, hooks, the store and the tools."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from corvid.functions import headings, urls
from corvid.operators import chunking, evaluate, index, lexical, results, runs, search, tools, vector
from corvid.sources import hooks, markdown, store
from corvid.streaming import events


def corpus(spark, n=60):
    r = random.Random(3)
    words = "agua ley norma salud presupuesto decreto acuerdo plan obra pago ñandú 2024".split()
    return spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(n)], "doc_id long, text string")


def test_index_grows_by_batches(spark, tmp_path):
    docs, path = corpus(spark), f"file://{tmp_path}/index"
    assert index.append(docs.limit(0), path) == 0
    assert index.append(docs.filter("doc_id < 20"), path) == 20
    assert index.append(docs, path) == 40 and index.append(docs, path) == 0
    # What an append leaves behind that did not come to its end is not read.
    lexical.doc_stats(corpus(spark, 5)).write.parquet(f"{path}/lengths/batch=broken")
    assert index.lengths(spark, path).count() == 60
    rows = sorted(map(tuple, index.postings(spark, path).select("term", "doc_id", "tf", "dl").collect()))
    assert rows == sorted(map(tuple, lexical.postings(docs).select("term", "doc_id", "tf", "dl").collect()))
    assert sorted(map(tuple, index.vocabulary(spark, path).collect())) == sorted(map(tuple, lexical.vocabulary(docs).collect()))
    q = spark.createDataFrame([(0, "ley de aguas y agua"), (1, "nada de nada"), (2, "ñandú 2024 pago")], "item_id long, text string")
    got, want = (sorted(map(tuple, x.collect())) for x in (index.bm25(spark, path, q, "item_id", 5), lexical.bm25(docs, q, "item_id", 5)))
    assert got == want and got
    plan = index.bm25(spark, path, q, "item_id", 5)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket#" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_index_beyond_named_terms(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "NAMED_TERMS", 1)
    docs, path = corpus(spark), f"file://{tmp_path}/index"
    index.append(docs, path)
    q = spark.createDataFrame([(0, "ley agua plan")], "item_id long, text string")
    assert sorted(map(tuple, index.bm25(spark, path, q, "item_id", 9).collect())) == sorted(map(tuple, lexical.bm25(docs, q, "item_id", 9).collect()))


def test_index_of_a_stream(spark, tmp_path):
    docs = corpus(spark)
    docs.filter("doc_id < 30").coalesce(1).write.parquet(f"{tmp_path}/in")
    path = f"file://{tmp_path}/index"
    for part in (docs.filter("doc_id >= 30"), None):
        index.append_stream(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), path, f"file://{tmp_path}/checkpoint")
        if part is not None:
            part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert index.lengths(spark, path).count() == 60 and index.batches(spark, path).count() == 2


def test_statistics_are_the_whole_corpus(spark):
    """A condition changes which documents are ranked, not their scores; without one, documents without metadata stay."""
    docs = corpus(spark)
    meta = docs.filter("doc_id % 2 = 0").select("doc_id", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") * 20).cast("int")).alias("publication_date"), F.lit("MAT").alias("section"))
    q = spark.createDataFrame([(0, "ñandú presupuesto")], "query_id long, text string")
    every = {r["doc_id"]: r["score"] for r in search.documents(docs, q, meta, top_k=100).collect()}
    some = {r["doc_id"]: r["score"] for r in search.documents(docs, q, meta, search.Filters(date_to="2021-01-01"), top_k=100).collect()}
    assert some and set(some) < set(every) and all(every[d] == s for d, s in some.items()) and any(d % 2 for d in every)
    for wrong in ({"strategy": "other"}, {"top_k": 0}, {"strategy": "vector"}):
        with pytest.raises(ValueError):
            search.documents(docs, q, meta, **wrong)


def test_titles_and_headings_outrank_mentions(spark):
    docs = spark.createDataFrame([(1, "decreto que expide la ley general de aguas"), (2, "ley general de aguas ley general de aguas citada"), (3, "otra cosa"), (4, "nada"), (5, "plan nacional"), (6, "x")], "doc_id long, text string")
    titles = spark.createDataFrame([(1, "Decreto por el que se expide la Ley General de Aguas"), (2, "Aviso"), (5, None)], "doc_id long, title string")
    paths = spark.createDataFrame([(5, ["ANEXO", "PLAN Nacional de Desarrollo 2019-2024"]), (6, ["Plan Nacional de Desarrollo 2013-2018"])], "doc_id long, heading_path array<string>")
    meta = docs.select("doc_id", F.lit(None).cast("date").alias("publication_date"), F.lit(None).cast("string").alias("section"))
    q = spark.createDataFrame([(0, "¿Qué dispone la Ley General de Aguas al declararse? Plan Nacional de Desarrollo  2019-2024")], "query_id long, text string")
    got = search.documents(docs, q, meta, titles=titles, headings=paths).orderBy("rank").collect()
    assert [(r["doc_id"], r["title_boost"]) for r in got][:2] == [(1, 200.0), (5, 200.0)] or [(r["doc_id"], r["title_boost"]) for r in got][:2] == [(5, 200.0), (1, 200.0)]
    assert next(r for r in got if r["doc_id"] == 2)["title_boost"] == 0.0


NAMES = {
    "¿Qué dice la Ley General de Aguas al declararse nula?": ["ley general de aguas"],
    "ley x": [],
    "el Código Penal Federal y el reglamento interior de salud": ["codigo penal federal y el reglamento interior de salud", "reglamento interior de salud"],
    "LEY DE a b c d e f g h i j k l m": ["ley de a b c d e f g h i j"],
    "": [],
}


def test_names_of_instruments(spark):
    rows = spark.createDataFrame(list(enumerate(NAMES)), "i int, t string").select("i", search.named_instruments(F.col("t")).alias("n")).orderBy("i").collect()
    assert [[" ".join(n) for n in r["n"]] for r in rows] == list(NAMES.values())


def test_provisions_and_definitions(spark):
    chunks = spark.createDataFrame([(0, 1, "véase 5.2 y agua"), (0, 2, "> **5.2** requisitos"), (0, 3, "**3.1 Agua potable:** la que se bebe"), (0, 4, "15.2 agua potable agua potable"), (0, 5, "5.2.1 nada")], "query_id long, chunk_id long, text string")
    q = spark.createDataFrame([(0, "¿Cómo se define agua potable en 5.2?")], "query_id long, text string")
    got = {r["chunk_id"]: r["score"] for r in lexical.chunk_bm25(chunks, q, "query_id").collect()}
    assert got[2] > 20 and got[3] > 20 and got[1] < 20 and got[4] < 20 and got.get(5, 0) < 20


def test_evidence_strategies_and_recency(spark):
    chunks = spark.createDataFrame([(1, 10, "agua potable"), (1, 11, "otra agua"), (2, 20, "agua agua potable"), (3, 30, "fuera")], "doc_id long, chunk_id long, text string")
    q = spark.createDataFrame([(0, "agua potable")], "query_id long, text string")
    hits = spark.createDataFrame([(0, 1), (0, 2)], "query_id long, doc_id long")
    near = spark.createDataFrame([(0, 11, 0.9, 1), (0, 30, 0.8, 2)], "query_id long, chunk_id long, score double, rank int")
    meta = spark.createDataFrame([(1, datetime.date(2024, 1, 1)), (2, datetime.date(2010, 1, 1))], "doc_id long, publication_date date")
    assert [r["chunk_id"] for r in search.evidence(chunks, q, hits, near, strategy="vector").orderBy("rank").collect()] == [11]
    both = {r["chunk_id"]: r["source"] for r in search.evidence(chunks, q, hits, near).collect()}
    assert both == {10: "bm25_chunk", 20: "bm25_chunk", 11: "hybrid"}
    first = search.evidence(chunks, q, hits, meta=meta, prefer_recent=True, recency_weight=1.0).orderBy("rank").first()
    assert first["doc_id"] == 1


def test_vectors_in_many_blocks(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(vector, "QUERY_VALUES", 40)
    monkeypatch.setattr(vector, "VECTOR_VALUES", 100)
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(150, 4)), 1)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (None, [1.0] * 4)], "vec_id long, embedding array<double>")
    got = vector.topk(rows, rows.filter("vec_id % 3 = 0"), 7, vector.euclidean, descending=False).collect()
    for q in range(0, 150, 3):
        d = np.round(np.sqrt(((x - x[q]) ** 2).sum(1)), 6)
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == sorted(range(150), key=lambda i: (d[i], i))[:7]
    with pytest.raises(ValueError, match="dimensions"):
        vector.topk(rows.union(spark.createDataFrame([(1, [1.0])], rows.schema)), rows, 3, vector.cosine)
    assert vector.topk(rows.limit(0), rows.limit(0), 3, vector.cosine).count() == 0


def test_phrases_of_all_lengths(spark):
    docs = spark.createDataFrame([(1, "a b a b a b c"), (2, "b a"), (3, None), (4, "a")], "doc_id long, text string")
    phrases = spark.createDataFrame([(1, ["a"]), (2, ["a", "b"]), (3, ["a", "b", "a", "b", "a", "b", "c"]), (4, ["c", "a"]), (5, [])], "q int, words array<string>")
    got = {(r["q"], r["doc_id"]): r["hits"] for r in lexical.phrase_hits(docs, phrases, "q").collect()}
    assert got == {(1, 1): 3, (1, 2): 1, (1, 4): 1, (2, 1): 3, (3, 1): 1}
    assert lexical.phrase_hits(docs, phrases.limit(0), "q").count() == 0


def test_recipes_give_chunks_back(spark):
    table = "# T\n\n| a | b |\n|---|---|\n" + "".join(f"| fila {i} | valor {i * 7} |\n" for i in range(1200))
    for text in (table, "## Uno\n\n" + "palabra otra " * 900 + "\n\n## Dos\n\n" + "x y z " * 2000, "corto"):
        _, rows = chunking.split(text)
        source = chunking.inlined(text)
        for r in rows:
            got = chunking.recipe(r["text"], source)
            assert "".join(x["lit"] if x["lit"] is not None else source[x["start"] : x["end"]] for x in got) == r["text"]
            assert len(got) < 40 and sum(len(x["lit"] or "") for x in got) < 0.2 * len(r["text"]) + 60
    docs = spark.createDataFrame([(1, table), (2, None), (3, "")], "doc_id long, text string")
    assert chunking.with_recipes(docs).columns[-1] == "spans" and chunking.with_recipes(docs).filter("doc_id = 2").count() == 0


def test_offsets_are_the_texts():
    text = "uno dos\n\n" + "largo " * 800 + "\n\n\ntres\n\ncuatro cinco\n\n"
    spans = chunking.offsets(text, 100)
    assert text[spans[0][0] : spans[0][1]] == "uno dos" and text[spans[-1][0] : spans[-1][1]] == "tres\n\ncuatro cinco"
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert all(chunking.default_count(text[a:b]) <= 110 for a, b in spans) and chunking.offsets("  \n\n ") == []


def test_structural_chunks():
    text = "# Uno\n\n" + "".join(f"Frase {i}. " for i in range(400)) + "\n\n## Dos\n\n```\ncode\n```\n\n- a\n- b\n\n" + "".join(chr(0x4E00 + i) for i in range(5000))
    got = chunking.structural(text)
    assert all(len(c) <= chunking.STRUCTURE_CHARS for _, c in got)
    whole = got[0][1]
    for _, c in got[1:]:
        k = next(k for k in range(min(len(c), chunking.STRUCTURE_SHARED), -1, -1) if whole.endswith(c[:k]))
        whole += c[k:]
    assert whole == text
    assert chunking.structural("   ") == [] and chunking.structural("uno") == [(1, "uno")]


@pytest.mark.parametrize("name", sorted(chunking.VARIANTS))
def test_ways_to_split_keep_all_words(name):
    text = "# T\n\nUna frase. Otra frase más larga que sigue!\n\n## Dos\n\n| a | b |\n|---|---|\n" + "".join(f"| c{i} | d{i} |\n" for i in range(60)) + "\n## Tres\n\n" + "palabra otra. " * 300
    got = chunking.VARIANTS[name](text, budget=100)
    assert "".join("".join(got).split()) == "".join(text.split())
    assert name == "tables" or all(chunking.default_count(x) <= 130 for x in got)
    assert chunking.VARIANTS[name]("  \n ") == []


def test_comparison_of_ways_to_split(spark):
    rows = chunking.compared(spark.createDataFrame([(1, "uno. dos."), (2, None)], "doc_id long, text string")).collect()
    assert len(rows) == 2 * len(chunking.VARIANTS) and all(r["chunks"] == (r["doc_id"] == 1) for r in rows)


def test_sibling_chains(spark):
    text = "# A\n## B\n### C\n### D\n## E\ntexto\n# F\n### G\n## H"
    rows = spark.createDataFrame([(text,)], "t string").select(headings.sibling_chains(headings.listed(F.col("t"))).alias("c")).first()["c"]
    assert [[h["text"] for h in x["chain"]] for x in rows] == [["A"], ["A", "B"], ["A", "B", "C"], ["A", "B", "C", "D"], ["A", "E"], ["F"], ["F", "G"], ["F", "H"]]


def test_urls(spark):
    names = ["x/23012025_MAT.md", "23012025-VES.md", "003_DOC_23012025_MAT.md", "corto.md"]
    rows = spark.createDataFrame(list(enumerate(names)), "i int, p string").select("i", urls.by_date(F.col("p")).alias("a"), urls.by_part(F.col("p")).alias("b")).orderBy("i").collect()
    assert "archivo=23012025-MAT.pdf&anio=2025" in rows[0]["a"] and "archivo=23012025-VES.pdf&anio=2025" in rows[1]["a"] and rows[3]["a"] is None
    assert rows[1]["b"] is None and "archivo=003-DOC-23012025-MAT.pdf&anio=2025" in rows[2]["b"]


def test_hooks_keep_files_apart(spark):
    files = spark.createDataFrame([("a.doc", b"good"), ("b.DOC", b"bad"), ("c.txt", b"x"), ("d.doc", b"done"), ("e.doc", b"")], "path string, content binary")

    def convert(path, content):
        if content == b"bad":
            raise OSError("broken")
        return content.decode()

    got = {r["path"]: r for r in hooks.converted(files, convert, files.filter("path = 'd.doc'"), wait=0).collect()}
    assert {p: r["status"] for p, r in got.items()} == {"a.doc": "ok", "b.DOC": "failed", "d.doc": "skipped", "e.doc": "too_small"}
    assert got["b.DOC"]["error"] == "OSError: broken" and got["b.DOC"]["tries"] == 3 and got["a.doc"]["output"] == "good"
    small = hooks.downloaded(spark.createDataFrame([("u1",), ("u2",)], "path string"), lambda p, _: b"x" * (2000 if p == "u1" else 5), wait=0)
    assert {r["path"]: (r["status"], r["output"] is None) for r in small.collect()} == {"u1": ("ok", False), "u2": ("too_small", True)}
    pages = spark.createDataFrame([(1, 2, b"two"), (1, 1, b"one"), (1, 3, b"bad"), (2, 1, b"x")], "doc_id long, page int, content binary")
    read = {r["doc_id"]: (r["text"], r["failed"]) for r in hooks.read_pages(pages, convert, wait=0).collect()}
    assert read == {1: ("one\n\ntwo", 1), 2: ("x", 0)}
    assert [r["path"] for r in hooks.rastered(spark.createDataFrame([("i.WMF", b"1"), ("j.png", b"2")], "path string, content binary"), lambda p, c: c).collect()] == ["i.WMF"]


def test_store_appends_and_replaces(spark, tmp_path):
    docs, path = corpus(spark, 10), f"file://{tmp_path}/store"
    assert store.append_documents(docs, path) == 10 and store.append_documents(docs, path) == 0
    log = spark.read.parquet(f"{path}/log").collect()
    assert len(log) == 1 and log[0]["docs_inserted"] == 10
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, chunk_index int, text string")
    for version, n in (("v1", 2), ("v1", 2), ("v2", 4)):
        store.append_chunks(chunks, f"{path}/chunks", version)
        assert spark.read.parquet(f"{path}/chunks").count() == n
    vectors = spark.createDataFrame([(1, [1.0])], "chunk_id long, embedding array<double>")
    store.append_vectors(vectors, f"{path}/vec", {"model": "m"})
    store.append_vectors(vectors, f"{path}/vec", {"model": "m"})
    assert spark.read.parquet(f"{path}/vec/vectors").count() == 1
    with pytest.raises(ValueError, match="other settings"):
        store.append_vectors(vectors, f"{path}/vec", {"model": "n"})
    table = f"file://{tmp_path}/parts"
    store.upsert(chunks.union(spark.createDataFrame([(2, 0, "c")], chunks.schema)), table, parts=4)
    store.upsert(spark.createDataFrame([(1, 0, "new")], chunks.schema), table, parts=4)
    assert sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(table).collect()) == [(1, "new"), (2, "c")]


def test_manifests_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([("2015/02/03022015/MAT/a.md", 5, 2015, "MAT", datetime.date(2015, 2, 3))], markdown.MANIFEST)
    markdown.write_manifest(rows, f"file://{tmp_path}/m")
    assert markdown.read_manifest(spark, f"file://{tmp_path}/m").collect() == rows.collect()
    (tmp_path / "t.md").write_text("| name | n |\n|---|---|\n| a | 1 |\ntext\n| b | 2 | 3 |\n| c | 4 |\n")
    assert [tuple(r) for r in markdown.markdown_table(spark, f"file://{tmp_path}/t.md", ["name", "n"]).collect()] == [("a", "1"), ("c", "4")]
    pdf = spark.createDataFrame([(b"%PDF" + b"x" * 1000,), (b"%PDF",), (b"html" * 500,)], "c binary").select(store.is_pdf(F.col("c")).alias("p")).collect()
    assert [r["p"] for r in pdf] == [True, False, False]


def test_a_folder_that_is_a_link_is_scanned(spark, tmp_path):
    real = tmp_path / "real" / "01" / "02012016" / "VES"
    real.mkdir(parents=True)
    (real / "b.md").write_text("x")
    (real / "a.md").write_text("y")
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "2016").symlink_to(tmp_path / "real")
    assert [r["relpath"] for r in markdown.scan(spark, f"{tmp_path}/corpus").collect()] == ["2016/01/02012016/VES/a.md", "2016/01/02012016/VES/b.md"]


def test_server_sent_lines():
    frames = [[{"kind": "started", "sequence": 2}, {"kind": "queued", "sequence": 1}], [], [{"kind": "failed", "sequence": 3}, {"kind": "late", "sequence": 4}]]
    got = list(events.server_sent(frames))
    assert [x.split("\n")[0] for x in got] == ["id: 1", "id: 2", ": heartbeat", "id: 3"] and "event: failed" in got[-1]


def test_empty_metrics(spark):
    none = spark.createDataFrame([], "run_id long, category string, stop_reason string, answer struct<text:string,citations:array<long>,invalid:array<long>,premise:string>, gold array<long>, coverage map<string,boolean>, tool_errors int, tool_calls int, turns int, elapsed_ms double, usage struct<input_tokens:long,output_tokens:long,total_tokens:long>")
    assert all(r["n"] == 0 and r["completion_rate"] is None for r in results.agent_metrics(none).collect())
    rows = spark.createDataFrame([(1, "c", "turn_limit", None, [1], {}, 1, 1, 1, 1.0, None)], none.schema)
    total = next(r for r in results.agent_metrics(rows).collect() if r["category"] is None)
    assert total["completion_rate"] == 0 and total["citation_recall"] is None and total["coverage_completion_rate"] is None


def test_pareto_and_visibility(spark):
    rows = spark.createDataFrame([("a", 1, 9.0), ("b", 2, 5.0), ("c", 2, 5.0), ("d", 1, 5.0), ("e", 3, 1.0)], "k string, x int, y double")
    assert sorted(r["k"] for r in evaluate.pareto(rows, "x", "y").collect()) == ["a", "b", "c", "e"]
    r = spark.createDataFrame([(1, "succeeded", True, "u"), (2, "started", True, "v"), (3, "started", None, "me")], "i int, s string, p boolean, o string")
    assert [x["v"] for x in r.orderBy("i").select(runs.visible(F.col("s"), F.col("p"), F.col("o"), "me").alias("v")).collect()] == [True, False, True]


def test_tools_over_tables(spark):
    docs = spark.createDataFrame([(1, "Norma de agua potable"), (2, "otra cosa"), (3, "más agua"), (4, "x"), (5, "y")], "doc_id long, text string")
    chunks = spark.createDataFrame([(10, 1, 0, "Norma de agua potable. " + "relleno " * 80 + "Artículo 3 dispone", ["NORMA"]), (11, 1, 1, "agua", []), (20, 2, 0, "otra", [])], "chunk_id long, doc_id long, chunk_index int, text string, heading_path array<string>")
    chunks = chunks.withColumns({"chunk_hash": F.sha2("text", 256), "token_count": F.length("text")})
    meta = docs.select("doc_id", F.date_add(F.lit("2020-01-01").cast("date"), F.col("doc_id").cast("int") * 365).alias("publication_date"), F.lit("MAT").alias("section"))
    titles = docs.select("doc_id", F.col("text").alias("title"))
    box = tools.Library(docs, chunks, meta, titles, cutoff="2024-06-01").toolbox()
    none = {"as_of": None, "date_from": None, "date_to": None, "section": None}
    listed = box.call("list_publications", none | {"limit": 3})
    assert [r["doc_id"] for r in listed] == [4, 3, 2] and listed[0]["title"] == "x"
    found = box.call("search_documents", none | {"query": "agua potable", "strategy": "hybrid", "prefer_recent": False, "top_k": 2})
    assert found[0]["doc_id"] == 1
    with pytest.raises(ValueError, match="cutoff"):
        box.call("search_documents", none | {"query": "agua", "as_of": "2025-01-01", "strategy": "lexical", "prefer_recent": False, "top_k": 2})
    seen = box.call("search_evidence", {"query": "artículo 3 agua", "document_ids": [1], "strategy": "lexical", "prefer_recent": True, "top_k": 5})
    assert seen and any("Artículo 3" in r["snippet"] and r["snippet_truncated"] for r in seen)
    assert [r["chunk_index"] for r in box.call("get_document_outline", {"document_id": 1})] == [0, 1]
    assert [r["chunk_id"] for r in box.call("read_chunks", {"chunk_ids": [10], "neighbor_window": 1})] == [10, 11]
    box.visible_chunks.add(99)
    with pytest.raises(ValueError, match="no chunks"):
        box.call("read_chunks", {"chunk_ids": [99], "neighbor_window": 0})
