"""The queries that SQL can express against DuckDB, on the smallest tables; the pipeline's stages against brute force."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.llm import common, mixing, quality, queries

from .conftest import SCHEMA
from .test_dedup import exact_truth


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(name, spark, data):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    other = c.sql(queries.ORACLE[name])
    names = list(other.columns)
    assert sorted(names) == columns
    assert sorted(repr([r[x] for x in columns]) for r in df.collect()) == sorted(repr([r[names.index(x)] for x in columns]) for r in other.fetchall())


def near_truth(texts, words=5, percent=80):
    """The documents that stay: the smallest of each component, found pair by pair."""
    sets = {}
    for d, t in texts.items():
        w = t.encode().lower().split()
        sets[d] = frozenset(zip(*[w[i:] for i in range(words)], strict=False)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {d for d in ids if find(d) == d}


def with_labels(folder, spark, rows, labelled):
    """A folder with tables of these rows and labels; the stages' result by brute force, as far as they go."""
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(rows, SCHEMA).withColumn("rep", F.lit(1)).withColumn("quality", F.lit("q")).write.parquet(f"{folder}/documents.parquet")


def test_stages_keep_what_brute_force_keeps(spark, rows, tmp_path):
    """Every stage on its own input: scores, exact groups, components, and the draw; the packed documents are those that are left."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as P

    junk = [(2000 + i, " ".join(["###", "|||"] * (5 + i % 7) + [f"x{i}"]), "s1", "en", 0) for i in range(60)]
    rows = rows + junk
    with_labels(tmp_path, spark, rows, [(r[0], 1, 0) for r in rows if r[1] and r[0] < 150] + [(r[0], 0, 0) for r in junk])
    docs = common.table(spark, str(tmp_path), "documents")
    columns = docs.columns
    held = {}

    def kept(k, docs):
        out = common.saved(P.STAGES[k][1](spark, docs, str(tmp_path)), "stage")
        assert out.columns == columns
        held[k] = {r["doc_id"]: r["text"] for r in out.collect()}
        return out

    model = quality.train(docs, common.table(spark, str(tmp_path), "labels"))
    score = {r[0]: float(model.score(np.array([quality.features((r[1] or "").encode())]))[0]) for r in rows}
    docs = kept(0, docs)
    assert set(held[0]) == {d for d, s in score.items() if s >= quality.CUT}
    assert not {r[0] for r in junk} & set(held[0]) and {r[0] for r in rows if r[1] and r[0] < 150} <= set(held[0])
    docs = kept(1, docs)
    assert set(held[1]) == {d for d, x in exact_truth([(d, t) for d, t in held[0].items()]).items() if x[2]}
    docs = kept(2, docs)
    assert set(held[2]) == near_truth({d: t or "" for d, t in held[1].items()})
    share = {r["doc_id"]: r["probability"] for r in mixing.mixed(docs).collect()}
    draw = {r["doc_id"]: r["u"] for r in docs.select("doc_id", mixing.uniform(F.col("doc_id")).alias("u")).collect()}
    docs = kept(3, docs)
    assert set(held[3]) == {d for d, p in share.items() if math.floor(p + draw[d]) >= 1}
    packed = P.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(held[3])
    tokens = Counter()
    for r in packed:
        tokens[r["doc_id"]] += r["length"]
    assert all(tokens[r["doc_id"]] == r["doc_tokens"] for r in packed)
    assert {r["doc_id"] for r in P.run(spark, str(tmp_path)).collect()} == set(held[3])


def test_stages_on_odd_tables(spark, none, tmp_path):
    """No rows at all; nulls in every column, empty and repeated rows, and one row beyond a slice."""
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as P

    with_labels(tmp_path / "none", spark, [], [])
    assert P.run(spark, str(tmp_path / "none")).count() == 0
    odd = [(None, None, None, None, None), (1, "", "s", "en", 0), (2, "a b", None, None, None), (2, "a b", None, None, None), (3, "word " * 500_000, "s", "en", 1), (None, "only me here", "s", "en", 2)]
    with_labels(tmp_path / "odd", spark, odd, [(1, None, None), (None, 1, 0)])
    docs = common.table(spark, str(tmp_path / "odd"), "documents")
    for _, stage in P.STAGES[:4]:
        docs = common.saved(stage(spark, docs, str(tmp_path / "odd")), "stage")
        assert docs.columns == [*(c.split()[0] for c in SCHEMA.split(", ")), "rep", "quality"]
    left = [(r["doc_id"], (r["text"] or "")[:12]) for r in docs.collect()]
    assert left.count((2, "a b")) in (0, 2) and set(left) <= {(None, ""), (1, ""), (2, "a b"), (3, "word word wo"), (None, "only me here")}


def test_workspace_deletes_what_it_owns(spark):
    import os

    with common.workspace():
        gone = common.saved(spark.range(3), "gone")
        stays = common.saved(spark.range(4), "stays", keep=True)
    path = stays._written_to.removeprefix("file://")
    assert stays.count() == 4 and os.path.exists(path) and not os.path.exists(gone._written_to.removeprefix("file://"))
    common.release(stays)
    assert not os.path.exists(path)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
    Context.master = "local[2]"
    assert common.shared_dir(Session()) == common.shared_dir(Session())
