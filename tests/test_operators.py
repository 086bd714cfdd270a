"""Operators on small tables, the store, sources and streams."""

import pytest
from pyspark.sql import functions as F

from corvid.operators import fusion, lexical, search, vector
from corvid.sources import html, markdown, store
from corvid.streaming import events


def test_weighted_and_rrf(spark):
    a = spark.createDataFrame([(0, 1, 10.0, 1), (0, 2, 1.0, 2)], "q int, i int, score double, rank int")
    b = spark.createDataFrame([(0, 2, 0.9, 1), (0, 1, 0.1, 2)], "q int, i int, score double, rank int")
    assert fusion.weighted(a, b, "q", "i", 0.75).orderBy("rank").first()["i"] == 1
    c = spark.createDataFrame([(0, 3, 1.0, 1), (0, 2, 0.5, 2)], "q int, i int, score double, rank int")
    assert fusion.rrf([a, c], "q", "i").orderBy("rank").first()["i"] == 2


def test_minmax_of_equal_scores(spark):
    a = spark.createDataFrame([(0, 1, 5.0), (0, 2, 5.0)], "q int, i int, score double")
    assert {r["norm"] for r in fusion.minmax(a, "q").collect()} == {0.0}


def test_recency(spark):
    rows = spark.createDataFrame([(0, 10, "2020-01-01"), (0, 11, "2021-01-01"), (0, 12, None), (0, 13, "2019-01-01")], "q int, i int, d string").withColumn("d", F.to_date("d"))
    got = {r["i"]: r["boost"] for r in fusion.recency_boost(rows, "q", "i", "d", 0.3).collect()}
    assert got[11] == 0.3 and 12 not in got and got[13] == pytest.approx(0.1)


def test_bm25_prefers_short_documents(spark):
    docs = spark.createDataFrame([(1, "agua potable"), (2, "agua " + "relleno " * 100), (3, "otra cosa"), (4, "nada"), (5, "más")], "doc_id long, text string")
    q = spark.createDataFrame([(0, "agua potable")], "item_id long, text string")
    assert [r["doc_id"] for r in lexical.bm25(docs, q, "item_id", 5).orderBy("rank").collect()] == [1, 2]


def test_filters():
    assert search.Filters(section=" mat ").section == "MAT"
    with pytest.raises(ValueError):
        search.Filters(date_from="2021-01-01", date_to="2020-01-01")
    with pytest.raises(ValueError):
        search.Filters(as_of="2022-01-01").within("2021-01-01")


def test_vector_ties(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(7)] + [(9, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = vector.topk(v, v.filter("vec_id = 9 OR vec_id = 0"), 3, vector.cosine).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(0, 0), (0, 1), (0, 2), (9, 9), (9, 0), (9, 1)]


def test_topk_is_cut_before_the_shuffle(spark, data):
    plan = lexical.bm25(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet"), "item_id", 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_read_chunks_checks_hashes(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id long, chunk_index int, text string")
    good = rows.withColumn("chunk_hash", F.sha2("text", 256))
    wanted = spark.createDataFrame([(1, 0)], "doc_id long, chunk_index int")
    assert [r["text"] for r in search.read_chunks(good, wanted, 1).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="hash differs"):
        search.read_chunks(rows.withColumn("chunk_hash", F.lit("no")), wanted).collect()


def test_evidence_falls_back_to_lexical(spark):
    chunks = spark.createDataFrame([(1, 10, "agua potable"), (1, 11, "otra"), (2, 20, "agua")], "doc_id long, chunk_id long, text string")
    q = spark.createDataFrame([(0, "agua potable")], "query_id long, text string")
    hits = spark.createDataFrame([(0, 1), (0, 2)], "query_id long, doc_id long")
    nothing = spark.createDataFrame([], "query_id long, chunk_id long, rank int")
    for vectors in (None, nothing):
        got = search.evidence(chunks, q, hits, vectors).orderBy("rank").collect()
        assert [r["chunk_id"] for r in got] == [10, 20] and {r["source"] for r in got} == {"bm25_chunk"}


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "path int, text string")
    path = f"file://{tmp_path}/docs"
    store.append_new(rows, path, ["path"])
    store.append_new(rows, path, ["path"])
    assert spark.read.parquet(path).count() == 2


def test_markdown_tree(spark, tmp_path):
    folder = tmp_path / "corpus" / "2015" / "02" / "03022015" / "MAT"
    folder.mkdir(parents=True)
    (folder / "a.md").write_text("# hola")
    (folder / "b.md.bak").write_text("x")
    rows = markdown.scan(spark, f"{tmp_path}/corpus").collect()
    assert len(rows) == 1 and rows[0]["section"] == "MAT" and str(rows[0]["publication_date"]) == "2015-02-03"
    assert markdown.texts(spark, f"{tmp_path}/corpus").first()["text"] == "# hola"


def test_lenient_jsonl(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"relpath": "a", "n": 1}\nbroken\n{"relpath": "a", "n": 2}\n{"relpath": "b", "error": "x"}\n')
    got = markdown.lenient_jsonl(spark, str(tmp_path / "q.jsonl"), "relpath string, n int", "relpath").collect()
    assert [(r["relpath"], r["n"]) for r in got] == [("a", 2)]
    with pytest.raises(Exception):
        markdown.strict_jsonl(spark, str(tmp_path / "q.jsonl"), "relpath string, n int").collect()


def test_notices(spark):
    page = '<div class="tab-pane" id="resp-tab2"><div class="panel-default"><div class="panel-heading"><span class="txt-traduct"> AVISOS </span></div><a href="/notas/12">x</a></div></div><div class="panel-default"><a href="/notas/13">y</a></div>'
    got = html.notices(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).collect()
    assert [(r["note_id"], r["edition"]) for r in got] == [("12", "VES")]


def test_streamed_windows(spark, data, tmp_path):
    """Late rows are dropped once the watermark has passed their window."""
    schema = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
    (tmp_path / "in").mkdir()
    for i, times in enumerate((["2024-01-01 00:10:00", "2024-01-01 05:00:00"], ["2024-01-01 00:20:00", "2024-01-01 09:00:00"])):
        rows = [(i * 10 + j, t, 1, "click", 1.0, None) for j, t in enumerate(times)]
        spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(f"{tmp_path}/batch{i}")
        part = next(p for p in (tmp_path / f"batch{i}").iterdir() if p.suffix == ".parquet")
        part.rename(tmp_path / "in" / f"{i}.parquet")
        query = events.tumbling(events.stream(spark, f"{tmp_path}/in", schema), "1 hour", "1 hour")
        events.drain(query, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("window_start").collect()
    assert [(r["window_start"].hour, r["n"]) for r in got] == [(0, 1), (5, 1)]


def test_embedding_retries_and_gives_up(spark):
    from corvid.operators import embedding

    class Flaky:
        def __init__(self):
            self.calls = 0

        def embed(self, texts):
            self.calls += 1
            if any("bad" in t for t in texts) or self.calls % 2:
                raise RuntimeError("no")
            return [[1.0, 0.0] for _ in texts]

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, None)], "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: r for r in embedding.embedded(df, Flaky, "doc_id", "text", batch=1, wait=lambda s: None).collect()}
    assert got[1]["embedding"] == [1.0, 0.0] and got[3]["error"] is None
    assert got[2]["embedding"] is None and got[2]["error"] == "RuntimeError: no"


def test_late_chunks(spark):
    tokens = spark.createDataFrame([(1, 0, 4, [1.0, 0.0]), (1, 4, 9, [0.0, 1.0]), (1, 9, 12, [4.0, 4.0])], "doc_id long, start int, end int, embedding array<double>")
    chunks = spark.createDataFrame([(1, 0, 0, 8), (1, 1, 9, 12)], "doc_id long, chunk_index int, start int, end int")
    got = {r["chunk_index"]: r["embedding"] for r in vector.late_chunks(tokens, chunks).collect()}
    assert got == {0: [0.5, 0.5], 1: [4.0, 4.0]}


def test_guarded_delete(spark):
    from corvid.operators import validation

    rows = spark.createDataFrame([("seed:a",), ("ana",), (None,)], "user string")
    assert validation.guarded_delete(rows, "user", "seed:").count() == 2
    with pytest.raises(ValueError):
        validation.guarded_delete(rows, "user", "a")


def test_store_guards_and_migration(spark):
    with pytest.raises(ValueError):
        store.guard({"dims": "64"}, {"dims": "128"})
    store.guard({"dims": "64"}, {"dims": "64", "model": "x"})
    old = spark.createDataFrame([(1, "x")], "id int, as_of_date string")
    new = store.migrated(old, {"as_of_date": "as_of"}, {"published_at": "timestamp"})
    assert new.columns == ["id", "as_of", "published_at"] and new.first()["published_at"] is None


def test_replace_partitions_keeps_the_others(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    store.replace_partitions(spark.createDataFrame([(1, 2020), (2, 2021)], "v int, year int"), path, ["year"])
    store.replace_partitions(spark.createDataFrame([(9, 2021)], "v int, year int"), path, ["year"])
    assert {(r["v"], r["year"]) for r in spark.read.parquet(path).collect()} == {(1, 2020), (9, 2021)}


def test_cache_is_reused_only_for_the_same_settings(spark, tmp_path):
    from corvid.sources import provenance

    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for meta in ({"m": "a"}, {"m": "a"}, {"m": "b"}):
        assert provenance.cached(spark, f"file://{tmp_path}/c", meta, make).count() == 3
    assert len(made) == 2
    assert provenance.fingerprint(spark.range(5)) == provenance.fingerprint(spark.range(5).repartition(3)) != provenance.fingerprint(spark.range(6))


def test_report(spark):
    from corvid.operators import evaluate

    text = evaluate.report(spark.createDataFrame([("a", 0.5), (None, 0.25)], "category string, mrr double"), "Metrics")
    assert "| a | 0.5000 |" in text and "| total | 0.2500 |" in text


def test_tail_delivers_after_the_cursor(spark, tmp_path):
    spark.createDataFrame([("r1", i) for i in range(1, 6)] + [("r2", 1)], "run string, sequence int").write.parquet(f"{tmp_path}/in")
    got = []
    rows = spark.readStream.schema("run string, sequence int").parquet(f"{tmp_path}/in")
    events.tail(rows, lambda run, e: got.append((run, [x["sequence"] for x in e])), "run", "sequence", {"r1": 3}, f"{tmp_path}/checkpoint").awaitTermination()
    assert got == [("r1", [4, 5])]
