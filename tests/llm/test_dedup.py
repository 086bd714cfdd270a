"""Exact copies, near copies and repeats against brute force."""

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corvid.llm import exact_dedup, jaccard, repeats
from corvid.llm.components import components

from .conftest import texts_of


def exact_truth(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), d))
    out = {}
    for norm, members in groups.items():
        for _, d in members:
            out[d] = (min(members)[1], len(members), min(members)[1] == d, hashlib.sha256(norm.encode()).hexdigest())
    return out


@pytest.mark.parametrize("options", [{}, {"shortest": 16, "longest": 64}, {"shortest": 16, "longest": 64, "fingerprint": lambda c: F.pmod(F.xxhash64(c), F.lit(7))}])
def test_exact(docs, rows, options):
    """The third case has a fingerprint with clashes everywhere, so variants must tell chunks apart."""
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_groups(docs, **options).collect()}
    assert got == exact_truth(rows)


def test_exact_is_native(docs):
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_chunks_make_up_the_text(spark):
    text = "abcdefghij klmnop qrst " * 900
    row = spark.range(1).select(F.lit(text).alias("t")).select(F.array_join(exact_dedup.chunks_of(F.col("t"), 64, 512), "").alias("b"), F.size(exact_dedup.chunks_of(F.col("t"), 64, 512)).alias("n"), F.size(exact_dedup.chunks_of(F.lit(""), 64, 512)).alias("z")).first()
    assert row["b"] == text and row["n"] > 10 and row["z"] == 0


def test_exact_empty_and_kept(none, docs, rows):
    assert exact_dedup.exact_groups(none).count() == 0
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, t in exact_truth(rows).items() if t[2]}


def test_exact_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a ")], "doc_id long, text string")
    got = exact_dedup.exact_groups(df).collect()
    assert len(got) == 3 and {(r["keep_id"], r["group_size"]) for r in got} == {(2, 3)}


def jaccard_truth(rows, words=4):
    sets = {}
    for d, t in texts_of(rows).items():
        w = t.encode().lower().split()
        sets[d] = frozenset(zip(*[w[i:] for i in range(words)], strict=False)) if len(w) >= words else frozenset([tuple(w)] if w else [])
    ids = sorted(sets)
    comp = {d: d for d in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = find(a), find(b)
                comp[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("most_small", [6, 20])
def test_near_copies(docs, rows, most_small):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.joined(docs, most_small=most_small).collect()}
    assert got == jaccard_truth(rows)


def test_near_copies_of_small_sets(spark):
    """Many sets of one to twenty elements that differ in one or two, where subsets are enumerated and sizes differ."""
    import random

    r = random.Random(11)
    rows = []
    for g in range(12):
        base = [f"w{g}x{i}" for i in range(r.randint(4, 24))]
        for k in range(8):
            w = list(base)
            for _ in range(k % 3):
                w.insert(r.choice([0, len(w)]), f"new{g}{k}{len(w)}") if r.random() < 0.5 else w.pop(r.choice([0, -1]))
            rows.append((len(rows), " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most_small in (0, 20):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.joined(df, most_small=most_small).collect()} == jaccard_truth(rows)


def test_near_copies_in_hot_lists(spark):
    """Every set shares its most frequent shingles with all others, and lists are cut by a second element from three sets on."""
    import random

    r = random.Random(21)
    shared = [f"hot{i}" for i in range(30)]
    rows = []
    for g in range(25):
        base = [f"g{g}x{i}" for i in range(r.randint(5, 60))]
        for k in range(4):
            w = list(base)
            for _ in range(k):
                w[r.randrange(len(w))] = f"new{g}{k}"
            rows.append((len(rows), " ".join(shared[: r.choice([12, 30])] + w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    truth = jaccard_truth(rows)
    for long_list in (0, 10_000):
        got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.joined(df, most_small=0, long_list=long_list).collect()}
        assert got == truth
    assert len({c for _, c in truth.values()}) > 20


def test_two_elements_are_shared_by_linked_sets():
    """What the cut of long lists rests on, over all pairs of sizes that can link."""
    for n in range(2, 200):
        p, q = jaccard.prefix_length(n), jaccard.index_length(n)
        assert 1 <= q <= p <= n
        for m in jaccard.partners(n):
            t = jaccard.needed(n, m)
            if t <= n:
                assert t >= 2 or n == m == 1
                assert n - t + 2 <= jaccard.index_length(n) + 1 and m - t + 2 <= jaccard.prefix_length(m) + 1


def test_near_copies_of_long_null_and_repeated_rows(spark):
    long = " ".join(str(i * i % 100_003) for i in range(700_000))
    rows = [(1, long), (2, long + " end"), (3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (4, "A B c d e"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit("k"), "role": F.lit(9), "component": F.lit("c")})
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in jaccard.joined(df).collect())
    assert got == [("1", "1"), ("2", "1"), ("3", "3"), ("3", "3"), ("4", "3"), ("5", "5"), ("None", "3")]


def test_subsets_are_complete():
    import itertools

    import numpy as np

    e = np.arange(1, 9, dtype=np.uint64)
    keys = jaccard.subset_keys(e, 20)
    wanted = sum(len(list(itertools.combinations(range(8), jaccard.needed(*p)))) for p in [(8, t) for t in jaccard.partners(8)] + [(7, 8)] if jaccard.needed(*p) <= p[0])
    assert len(keys) == len({k for k, _ in keys}) == wanted == jaccard.subset_count(8)


def test_sketches_never_rule_out_links():
    import random

    import numpy as np

    r = random.Random(2)
    for _ in range(200):
        n = r.randint(1, 900)
        a = np.array(r.sample(range(1 << 40), n), np.uint64)
        b = np.unique(np.concatenate([a[: n - r.randint(0, n // 8)], np.array(r.sample(range(1 << 40), r.randint(0, n // 8)), np.uint64)]))
        a = np.unique(a)
        if jaccard.linked(a.tobytes(), b.tobytes(), 85):
            assert jaccard.fine_may_link(jaccard.fine_sketch(a), jaccard.fine_sketch(b), 85)
            apart = int(np.bitwise_count((jaccard.parity(a) ^ jaccard.parity(b)).view(np.uint64)).sum())
            assert 185 * apart <= 15 * (len(a) + len(b))


def test_near_copies_empty(none):
    assert jaccard.joined(none).count() == 0


def test_one_of_each(docs, rows):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, (_, c) in jaccard_truth(rows).items() if d == c}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def repeats_truth(rows, window):
    words = {d: t.encode().split() for d, t in texts_of(rows).items()}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[d] = (len(w), len(w) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize("window", [35, 20])
def test_repeats(docs, rows, window):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in repeats.removed(docs, window=window).collect()}
    assert got == repeats_truth(rows, window)


def test_repeats_random(spark):
    """Few distinct words, so that runs, periods and overlaps with itself abound."""
    import random

    r = random.Random(8)
    rows = []
    for i in range(40):
        period = [r.choice("abc") for _ in range(r.randint(1, 6))]
        w = period * r.randint(1, 30) if i % 3 == 0 else [r.choice("ab") for _ in range(r.randint(0, 200))]
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in repeats.removed(df).collect()}
    assert got == repeats_truth(rows, 35)


def test_symbols_are_consistent():
    """Equal stretches have equal symbols wherever their context lies within them."""
    import numpy as np

    rng = np.random.default_rng(4)
    core = rng.integers(0, 50, 120).astype(np.uint64)

    def inner(left, right):
        w = np.concatenate([rng.integers(0, 50, left).astype(np.uint64), core, rng.integers(0, 50, right).astype(np.uint64)])
        names, at = repeats.symbols(w, np.zeros(len(w), np.int64), np.array([0]), np.array([len(w)]))
        return {(int(n), int(a - left)) for n, a in zip(names, at, strict=True) if a >= left and a - left + repeats.CONTEXT <= len(core)}

    assert inner(7, 30) == inner(55, 3) != set()


def test_repeats_empty_and_text(none, docs):
    assert repeats.removed(none).count() == 0
    row = repeats.removed(docs, with_text=True).filter("doc_id = 0").first()
    assert hashlib.sha256(row["kept_text"].encode()).hexdigest() == row["kept_sha256"]


def test_the_stage_links_at_five_words_and_four_fifths(spark, rows):
    """Against brute force, with pairs between 0.80 and 0.85 and sets small and large on both sides of the threshold."""
    import corpus_pipeline

    made = [(d, t) for d, t in texts_of(rows).items()]
    for size in (9, 14, 22, 60, 100, 140, 180):
        for changes in range(4):
            w = [f"v{size}x{i}" for i in range(size)]
            for c in range(changes):
                w[(c + 1) * size // (changes + 1)] = f"new{changes}y{c}"
            made.append((5000 + len(made), " ".join(w[: size - changes % 2])))
    sets = {}
    for d, t in made:
        w = t.encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    group = {d: d for d in sets}
    between = 0
    for a in sorted(sets):
        for b in sorted(sets):
            common, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if a < b and common and 100 * common >= 80 * union:
                between += 100 * common < 85 * union
                lo, hi = sorted((group[a], group[b]))
                group = {d: lo if g == hi else g for d, g in group.items()}
    assert between
    docs = spark.createDataFrame(made, "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()} == {d for d, g in group.items() if d == g}


def test_exact_ids_null_and_shared(spark):
    """Rows without doc_id, and rows that share one but not the text."""
    df = spark.createDataFrame([(None, "a b"), (3, "ab"), (5, "x y"), (5, "ab"), (6, "xy"), (7, None), (8, " ")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df).collect())
    assert got == [("3", "None", 3, False), ("5", "5", 2, True), ("5", "None", 3, False), ("6", "5", 2, False), ("7", "8", 2, False), ("8", "8", 2, True), ("None", "None", 3, True)]
    assert sorted((str(r["doc_id"]), r["text"]) for r in exact_dedup.dedup(df).collect()) == [("5", "x y"), ("8", " "), ("None", "a b")]


def test_exact_long_texts(spark):
    base = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(3_000_000))
    df = spark.createDataFrame([(1, base), (2, base[:2_999_999] + "!"), (3, " " + base)], "doc_id long, text string")
    assert sorted((r["doc_id"], r["keep_id"]) for r in exact_dedup.exact_groups(df).collect()) == [(1, 3), (2, 2), (3, 3)]


@pytest.mark.parametrize("plain", [0, 1_000_000])
def test_components_of_a_long_path_and_a_hub(spark, plain):
    edges = spark.createDataFrame([(i * 7 % 307, (i + 1) * 7 % 307) for i in range(306)] + [(1000, 1000 + i) for i in range(1, 400)], "a long, b long")
    got = {r["node"]: r["component"] for r in components(edges, plain).collect()}
    assert got == {i: 0 for i in range(307)} | {i: 1000 for i in range(1000, 1400)}
    assert components(edges.limit(0), plain).count() == 0



def test_repeats_of_a_passage_in_every_slice(spark, monkeypatch):
    """A passage that all documents have, with other words around it, in many slices of text and in runs of one word."""
    import random

    monkeypatch.setattr(repeats, "PIECE_BYTES", 3000)
    r = random.Random(5)
    passage = [f"p{i}" for i in range(50)]
    rows = []
    for i in range(150):
        w = [f"u{i}x{k}" for k in range(r.randint(0, 60))] + passage + [f"v{i}x{k}" for k in range(r.randint(0, 60))]
        rows.append((i, " ".join(w + ["same"] * (i % 3 * 40))))
    rows += [(None, " ".join(passage)), (7, " ".join(passage[:36])), (7, " ".join(passage[:34]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({"print": F.lit(1), "anchor": F.lit("a"), "mask": F.lit(0)})
    got = sorted((str(x["doc_id"]), x["n_words"], x["n_removed"], x["kept_sha256"]) for x in repeats.removed(df).collect())
    truth = repeats_truth([(k, t) for k, (_, t) in enumerate(rows)], 35)
    assert got == sorted((str(d), *truth[k]) for k, (d, _) in enumerate(rows))


def test_repeats_of_long_texts(spark):
    """Texts beyond a slice, with one another's passages."""
    import random

    r = random.Random(6)
    a = [str(r.randrange(10**6)) for _ in range(900_000)]
    b = [str(r.randrange(10**6)) for _ in range(400_000)] + a[500_000:500_100] + ["end"]
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, "x")]
    got = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in repeats.removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (900_000, 100), 2: (400_101, 100), 3: (1, 0)}
