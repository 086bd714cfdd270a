"""Packing, extraction, mixing, quality, archives, scores and media."""

import base64
import hashlib
import math
import struct
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.llm import archive, common, html_extract, media, mixing, packing, quality, scoring, tokens
from corvid.llm.pages_made import labelled_pages

from .conftest import texts_of


@pytest.fixture(scope="module")
def token_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_word_tokenizer(rows, token_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_path)
    own = tokens.WordTokenizer(token_path, cached=50)
    odd = ["It's <|endoftext|> I'M x", "é́́ foo bar, ba r", "<|ENDOFTEXT|>", "a.b.c,,d!! 'll 12,5 ÀB", "ﬁ ½ x² Σας ΣΑΣ. мир, 日本語。 \x1c\x85 a\x1cb", "don't. won't!!! (x). [y]&&&"]
    for text in [*texts_of(rows).values(), *odd]:
        assert np.frombuffer(own.encode([text.encode()])[0], own.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_ids_where_punctuation_is_cut_off(token_path):
    """A last letter that lower case or normal form ends with a mark keeps its punctuation; long words are not remembered."""
    from tokenizers import Tokenizer

    whole, own = Tokenizer.from_file(token_path), tokens.WordTokenizer(token_path, cached=200)
    odd = ["İ. Aİ*** İstanbul.", "\u0958. ש\ufb1d!", "ÖL. öl, straße. STRASSE.", "12. x1; ², 漢字. 😀.", "... a.. .a a.b.", "<|endoftext|>. a|<|endoftext|>|", "\xa0. a\xa0.", "K. Å!", f"{'ab' * 40}. {'ö' * 33}, {'x' * 64} {'x' * 65}", ""]
    rng = np.random.default_rng(5)
    signs = np.array(list("abzABÖéßİ漢1\u0338\u0301'.,;!*#|<> \n\xa0😀"))
    odd += ["".join(rng.choice(signs, n)) for n in rng.integers(1, 60, 1500)]
    for _ in range(2):
        for i in range(0, len(odd), 40):
            for text, got in zip(odd[i : i + 40], own.encode([t.encode() for t in odd[i : i + 40]]), strict=True):
                assert np.frombuffer(got, own.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)
            assert own.known.size <= 200


def test_words_whose_hashes_clash(token_path, monkeypatch):
    monkeypatch.setattr(tokens, "mix", lambda x, salt=0: x & np.uint64(1))
    known = tokens.Known(np.dtype("<u2"))
    words = [b"a", b"b", b"ab", b"abcdefgh", b"abcdefghi", b"abcdefghj"]
    text, sizes = np.frombuffer(b"".join(words) + bytes(8), np.uint8), np.array(list(map(len, words)))
    starts = np.cumsum(sizes) - sizes
    for k in range(len(words)):
        hashes, rows = known.find(text, starts[k : k + 1], sizes[k : k + 1])
        assert rows[0] == -1  # another word of this hash is not this word
        known.add(hashes, words[k : k + 1], [bytes([k, 0])])
    rows = known.find(text, starts, sizes)[1]
    assert set(rows) - {-1} and all(r in (-1, k) for k, r in enumerate(rows))


def test_few_words_take_the_whole_way_through_the_tokenizer(token_path):
    """What costs CPU time: words of plain letters, with punctuation after them or not, meet no regular expression."""
    own = tokens.WordTokenizer(token_path)
    real, whole = own.tokenizer, []

    class Counted:
        def __getattr__(self, name):
            return getattr(real, name)

        def __setattr__(self, name, value):
            setattr(real, name, value)

        def encode_batch_fast(self, texts, **how):
            whole.extend(texts if real.normalizer is not None else [])
            return real.encode_batch_fast(texts, **how)

    own.tokenizer = Counted()
    words = [a + b + c for a in ("ab", "straß", "the", "né") for b in ("er", "über", "ing") for c in ("o", "Ü", "ly")]
    own.encode([" ".join(w + t for w in words for t in ("", ".", ",", "***", "&&&")).encode()])
    assert sum(map(len, whole)) < 20


def test_a_tokenizing_worker_keeps_no_large_free_blocks(token_path):
    code = f"""
import re, numpy as np, pyarrow as pa
from corvid.llm import tokens
tokens.word_tokenizer({token_path!r})
held = lambda: int(re.search(r"Rss:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
for size in (31, 2):  # what is freed once would be kept from then on
    blocks = [np.ones(size << 17) for _ in range(20)]
    small = [bytes(100_000) for _ in range(5)]
    before = held()
    del blocks
    print(before - held(), pa.default_memory_pool().backend_name)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120).stdout.split()
    assert int(out[2]) >= 35 and out[1] == out[3] == "system"


def test_packing(docs, rows, none, token_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(token_path)
    ids = {d: np.array([*whole.encode(t, add_special_tokens=False).ids, 2], "<u4") for d, t in texts_of(rows).items()}
    got = packing.pack(docs, token_path, range_tokens=20_000).collect()
    at = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids[r["doc_id"]])
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(piece.tobytes()) == r["ids_crc32"]
        at[r["doc_id"]] = r["start"] + r["length"]
    assert at == {d: len(x) for d, x in ids.items()}
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used.get(r["sequence_id"], 0)
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 4096 and sum(v < 4096 for v in used.values()) <= 8
    assert packing.pack(none, token_path).count() == 0


def test_hilbert_is_a_walk():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    place = packing.hilbert_index(cells, 3)
    assert sorted(place) == list(range(512))
    walk = cells[np.argsort(place)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_extraction_on_held_out_pages():
    field = html_extract.default_field()
    right = total = 0
    for page, labels in labelled_pages(200, seed=77):
        found = html_extract.blocks(page)
        if len(found) == len(labels):
            right += sum(a == b for a, b in zip(field.decode(found), labels, strict=True))
            total += len(labels)
    assert total > 3000 and right / total > 0.98


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(0)
    page = html_extract.blocks("<nav><a href=x>Home</a></nav><article><h1>T</h1><p>One.</p><p>Two three.</p></article><footer>c</footer>")
    names = {f for fs in html_extract.features(page) for f in fs}
    field = html_extract.Field({n: float(rng.normal()) for n in names}, rng.normal(size=(2, 2)))
    emit = [sum(field.weights[f] for f in fs) for fs in html_extract.features(page)]

    def value(labels):
        return sum(e * y for e, y in zip(emit, labels, strict=True)) + sum(field.pairs[a, b] for a, b in zip(labels, labels[1:], strict=False))

    assert value(field.decode(page)) == pytest.approx(max(value(x) for x in itertools.product((0, 1), repeat=len(page))))


def test_extraction(spark):
    page = '<html><head><title>no</title></head><body><nav><ul><li><a href=a>Menu</a><li><a href=b>More</a></ul></nav><div class="cookie-notice">We use cookies.</div><article><h1>A&amp;B &eacute;</h1><p>First  text\n with <b>bold</b> words.<p>Second one.<script>x("<p>")</script></p><div class="ad">Buy now!</div></article><div id=comments><p>Great article, thanks a lot.</p></div><footer>&copy; me</footer></body></html>'
    df = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<div"), (5, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(-1))
    got = {r["page_id"]: r for r in html_extract.extract(df).collect()}
    assert got[1]["text"] == "A&B é\n\nFirst text with bold words.\n\nSecond one." == got[5]["text"]
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == got[3]["text"] == got[4]["text"] == "" and got[2]["n_chars"] == 0
    assert html_extract.extract(df.limit(0)).count() == 0


def test_raking_meets_its_targets():
    import pandas as pd

    rng = np.random.default_rng(1)
    cells = pd.DataFrame([(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(50, 500))) for a in range(4) for b in range(3) for c in range(2)], columns=["source", "lang", "topic", "tokens"])
    targets = mixing.Targets({"source": {"s0": 0.4, "s1": 0.2, "s2": 0.2, "s3": 0.2}, "lang": {"l0": 0.5, "l1": 0.25, "l2": 0.25}, "topic": {"t0": 0.5, "t1": 0.5}}, fraction=0.2, most=1.0)
    p = mixing.rake(cells, targets)
    kept = cells.assign(kept=p * cells["tokens"])
    assert kept["kept"].sum() == pytest.approx(0.2 * cells["tokens"].sum())
    for margin, shares in targets.shares.items():
        got = kept.groupby(margin)["kept"].sum() / kept["kept"].sum()
        assert dict(got) == pytest.approx(shares, abs=1e-6)


def test_mixing(spark, docs, rows, none):
    got = {r["doc_id"]: r for r in mixing.mixed(docs).collect()}
    assert len(got) == len(rows) and all(0 <= r["probability"] <= 1 for r in got.values())
    assert got[1000]["source"] == "unknown" and got[1000]["tokens"] == 1 and got[1000]["topic"] == "0"
    assert {d for d in got if got[d]["copies"]} == {r["doc_id"] for r in mixing.sampled(docs).collect()}
    assert mixing.mixed(none).count() == 0


def test_mixing_starts_no_workers_but_those_of_arrow(spark, docs):
    key = "spark.sql.execution.arrow.pyspark.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        assert "ExistingRDD" not in mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)


def test_raking_by_steps_is_the_same(spark):
    """The DataFrame steps against the driver's sweeps, on a few cells and few sweeps, and on none."""
    import pandas as pd

    rng = np.random.default_rng(4)
    cells = pd.DataFrame([(f"s{a}", f"l{b}", f"t{c}", int(rng.integers(5, 500))) for a in range(3) for b in range(2) for c in range(2)], columns=["source", "lang", "topic", "tokens"])
    targets = mixing.Targets({"source": {"s0": 0.6}}, fraction=0.7, sweeps=2)
    df = spark.createDataFrame(cells)
    got = {(r["source"], r["lang"], r["topic"]): r["p"] for r in mixing._raked_by_steps(df, targets).collect()}
    for p, row in zip(mixing.rake(cells, targets), cells.itertuples(), strict=True):
        assert got[row.source, row.lang, row.topic] == pytest.approx(p, abs=1e-12)


def test_topics_against_brute_force(spark):
    """Documents of three vocabularies in two languages: vectors, means, passes and topics in plain NumPy give the same, and the
    vocabularies are what the topics find."""
    from corvid.llm import topics

    rng = np.random.default_rng(9)
    rows = []
    for i in range(240):
        lang, theme = ("en", "de")[i % 2], i // 2 % 3
        common, own = [f"{lang}{k}" for k in range(20)], [f"{lang}theme{theme}x{k}" for k in range(60)]
        rows.append((i, " ".join([*rng.choice(common, 30), *rng.choice(own, 60)]), "s", lang))
    rows.append((999, None, None, None))
    got = {r["doc_id"]: r["topic"] for r in mixing.measured(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), topics=6).collect()}
    assert got.pop(999) == "0"
    x = {}
    for d, t, _, lang in rows[:-1]:
        c = Counter(t.encode().split())
        words = mixing.hash_words(list(c))
        v = (topics.directions(words) * (1 + np.log(np.array(list(c.values()))))[:, None]).sum(0)
        x[d] = (lang, v / np.linalg.norm(v))
    means = {g: np.mean([v for lang, v in x.values() if lang == g], 0) for g in ("en", "de")}
    z = {d: topics.unit(v - means[lang]).astype(np.float32).astype(float) for d, (lang, v) in x.items()}
    centres = np.array([topics.unit(np.sum([z[d] for d in z if got[d] == str(k)], 0)) if str(k) in got.values() else np.full(topics.DIMS, -9.0) for k in range(6)])
    # Settled: each document is nearest to the centre of its own topic, but for few at the last pass.
    assert np.mean([str((centres @ z[d]).argmax()) == got[d] for d in z]) > 0.97
    purity = sum(max(Counter(got[d] for d in z if (rows[d][3], d // 2 % 3) == key).values()) for key in {(rows[d][3], d // 2 % 3) for d in z})
    assert purity / len(z) > 0.9


def test_margins_that_documents_achieve(spark, docs):
    """Probabilities meet feasible targets exactly; what is drawn comes near; sums are the documents' own."""
    many = docs.crossJoin(spark.range(12).withColumnRenamed("id", "k")).withColumn("doc_id", F.col("doc_id") * 100 + F.col("k")).filter(F.length("text") < 5000)
    targets = mixing.Targets({"source": {"s0": 0.5}, "lang": {"en": 0.6}}, fraction=0.3)
    rows = mixing.mixed(many, targets)
    got = {(r["margin"], r["value"]): r for r in mixing.achieved(rows, targets).collect()}
    assert got["source", "s0"]["target"] == pytest.approx(0.5) and got["lang", "en"]["target"] == pytest.approx(0.6)
    # One language has a single word, which can't have its whole share at a probability of 1.
    assert all(r["expected"] == pytest.approx(r["target"], abs=1e-3) and r["drawn"] == pytest.approx(r["target"], abs=0.06) for r in got.values())
    plain = rows.collect()
    total = sum(r["tokens"] * r["copies"] for r in plain)
    assert got["source", "s0"]["drawn"] == pytest.approx(sum(r["tokens"] * r["copies"] for r in plain if r["source"] == "s0") / total)
    assert sum(r["tokens"] * r["probability"] for r in plain) == pytest.approx(0.3 * sum(r["tokens"] for r in plain), rel=1e-6)


def test_mixing_of_repeated_null_and_long_rows(spark):
    rows = [(1, "a b", None, "en"), (1, "a b", "s", "en"), (None, "c", "s", None), (2, "word " * 600_000, "s", "en"), (3, "", "s", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumns({"tokens": F.lit(-1), "vector": F.lit("v"), "p": F.lit(0)})
    got = mixing.mixed(df).collect()
    assert sorted((str(r["doc_id"]), r["tokens"]) for r in got) == [("1", 2), ("1", 2), ("2", 600_000), ("3", 1), ("None", 1)]
    assert mixing.sampled(df).columns == df.columns


def labelled(n=600):
    rng = np.random.default_rng(6)
    out = []
    for i in range(n):
        w = ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 8))) for _ in range(rng.integers(5, 80))]
        bad = rng.random() < 0.3
        out.append((i, " ".join(x + "###" for x in w) if bad else " ".join(w) + ".", int(not bad)))
    return out


def test_quality_on_the_held_out_fold(spark, none):
    made = labelled()
    df = spark.createDataFrame([(i, t) for i, t, _ in made] + [(9998, None), (9999, "")], "doc_id long, text string").withColumn("quality", F.lit(0))
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in made], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classified(df, labels).collect()}
    held = [(i, q) for i, _, q in made if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i, _ in held) and sum(r["held_out"] for r in got.values()) >= len(held)
    assert np.mean([got[i]["predicted"] == q for i, q in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in got.items() if r["predicted"]}
    nothing = quality.classified(df, labels.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.5}
    assert quality.classified(none, labels).count() == 0


def test_quality_features_against_brute_force():
    for text in (b"", b"  ", b"ab", b"Abc abc\nABC. xyz!", "Größe über alles\n\n12 ##".encode() * 9):
        x = quality.features(text)
        low = bytes(c + 32 if 65 <= c <= 90 else c for c in text)
        grams = Counter()
        for i in range(len(low) - 2):
            code = low[i] << 16 | low[i + 1] << 8 | low[i + 2]
            grams[(code * 2654435761 & 0xFFFFFFFF) >> 26] += 1
        assert x[len(quality.NAMES) :] == pytest.approx([grams[k] / max(1, len(low) - 2) for k in range(quality.GRAMS)])
        if text.strip():
            words = text.split()
            assert x[quality.NAMES.index("log_words")] == pytest.approx(math.log1p(len(words)))
            assert x[quality.NAMES.index("top_word")] == pytest.approx(max(Counter(words).values()) / len(words))
            assert x[quality.NAMES.index("upper")] == pytest.approx(sum(65 <= c <= 90 for c in text) / len(text))


def test_quality_weights_are_the_minimum():
    """The gradient of the pairwise logistic loss, computed pair by pair, is 0 at the weights; and the cut is the best quantile."""
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(60, quality.WIDTH))) / 50
    y = (x[:, 0] + rng.normal(size=60) / 100 > x[:, 0].mean()).astype(int)
    m = quality.fit(x, y, pairs=500)
    z = np.clip((quality.expand(x) - m.centre) / m.spread, -8, 8)
    rng = np.random.default_rng(7)
    up, down = rng.choice(np.flatnonzero(y == 1), 500), rng.choice(np.flatnonzero(y == 0), 500)
    decay = 1e-3 * np.where(np.arange(z.shape[1]) < z.shape[1] - quality.GRAMS, 1, quality.GRAM_DECAY)
    gradient = decay * m.weights
    for a, b in zip(up, down, strict=True):
        d = z[a] - z[b]
        gradient -= d / (1 + math.exp(d @ m.weights)) / 500
    assert np.abs(gradient).max() < 1e-5
    strength = m.strength(x)

    def balance(t):
        return (strength[y == 1] > t).mean() + (strength[y == 0] <= t).mean()

    assert balance(m.threshold) >= max(balance(t) for t in strength) - 1e-9


def test_quality_of_repeated_null_and_long_rows(spark):
    """Repeated and contradicting ids are learned once, whatever the order; equal texts tie; names clash."""
    made = labelled(200)
    rows = [(i, t) for i, t, _ in made] + [(3, "zzz"), (3, "zzz"), (None, made[0][1]), (5000, "word " * 700_000), (5001, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("s"), "x": F.lit(1), "quality": F.lit(5)})
    labels = spark.createDataFrame([(i, q) for i, _, q in made] + [(3, 0), (3, 1), (4, None)], "doc_id long, quality int")
    one = sorted((str(r["doc_id"]), r["held_out"], round(r["score"], 9)) for r in quality.classified(df, labels).collect())
    two = sorted((str(r["doc_id"]), r["held_out"], round(r["score"], 9)) for r in quality.classified(df.repartition(7), labels.repartition(3)).collect())
    assert one == two and len(one) == len(rows)
    by = {}
    for d, _, v in one:
        by.setdefault(d, set()).add(v)
    assert by["None"] == by["0"]


def pages():
    big = "<p>" + "x" * 1200 + "é</p>"
    return [(1, "http://a/1", big), (2, "http://a/2", "<p>small</p>"), (3, None, big), (4, "http://ä/4 4", None), (5, "http://a/5", ""), (6, "http://a/6", "<p>small</p>"), (7, "http://a/7", big), (8, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" * 100)]


def test_archive(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("file", F.lit("f"))
    index = archive.write(df, file_bytes=700)
    got = {r["page_id"]: r for r in archive.read(index).collect()}
    for page, _, html in pages():
        body = (html or "").encode()
        r = got[page]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        revisit = page in (1, 3)
        assert (r["record_type"], r["refers_to"]) == (("revisit", 7) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else body)
    some = archive.read(index.filter("page_id IN (2, 6)")).collect()
    assert {r["page_id"] for r in some} == {2, 6}
    assert archive.read(archive.write(df.limit(0))).count() == 0


def test_archive_of_repeated_and_null_ids(spark):
    """A row is a revisit of what it equals, whatever else has its page_id; rows without one are responses."""
    big = "y" * 1500
    rows = [(1, "u", big), (1, "u", "small"), (7, "v", big), (None, "w", big), (None, None, None), (7, "v", big)]
    got = archive.read(archive.write(spark.createDataFrame(rows, "page_id long, url string, html string")), payload=False).collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in got) == [("1", 5, "response", None), ("1", 1500, "revisit", 7), ("7", 1500, "response", None), ("7", 1500, "response", None), ("None", 0, "response", None), ("None", 1500, "response", None)]
    assert all(r["payload"] is None for r in got)


def test_a_revisit_names_its_response():
    body = b"x" * 1200
    first, again = (dict(archive.parse(archive.record(p, "u", body, ref))[0]) for p, ref in ((9, None), (2, 9)))
    assert again["WARC-Refers-To"] == first["WARC-Record-ID"] != again["WARC-Record-ID"]


def test_archive_of_long_payloads(spark):
    """Payloads beyond a batch's bytes and beyond one read."""
    import random

    r = random.Random(1)
    rows = [(i, "u", "".join(map(chr, r.choices(range(33, 500), k=700_000)))) for i in range(6)]
    got = {x["page_id"]: x for x in archive.read(archive.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)), most=100_000).collect()}
    assert all(got[i]["payload"].decode() == t for i, _, t in rows)


def test_a_broken_archive_is_noticed(spark):
    index = archive.write(spark.createDataFrame(pages()[:2], "page_id long, url string, html string"))
    with pytest.raises(Exception, match="digest is not the index's"):
        archive.read(index.withColumn("digest", F.lit("00"))).collect()


def test_ranges_are_joined():
    assert archive.coalesce([(0, 10), (12, 5), (1000, 5)], gap=4, most=100) == [(0, 17, [0, 1]), (1000, 5, [2])]
    assert archive.coalesce([(0, 10), (10, 10)], gap=4, most=15) == [(0, 10, [0]), (10, 10, [1])]


def test_a_record_is_plain_warc():
    raw = archive.record(3, "http://a/", b"body\r\n\r\n", None)
    fields, body = archive.parse(raw)
    assert body == b"body\r\n\r\n" and raw.endswith(b"\r\n\r\n") and fields["WARC-Type"] == "response"
    assert base64.b32decode(fields["WARC-Payload-Digest"][5:]) == hashlib.sha1(body).digest()


def base_truth(rows):
    words = {d: [*t.encode().lower().split(), None] for d, t in texts_of(rows).items()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in words}
    counts = Counter(w for d, ws in words.items() if not held[d] for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    out = {d: (held[d], len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)) for d, ws in words.items()}
    return out


@pytest.mark.parametrize("head", [scoring.HEAD_WORDS, 40])
def test_scores(docs, rows, head):
    got = {r["doc_id"]: r for r in scoring.scored(docs, head_words=head).collect()}
    for d, (held, n, known, total, base) in base_truth(rows).items():
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] <= 0
    copies = [d for d, t in texts_of(rows).items() if t == texts_of(rows)[1003]]
    assert len({got[d]["score"] for d in copies}) == 1


def test_scores_empty(none):
    assert scoring.scored(none).count() == 0


def test_filter_levels():
    """Each n-gram's level comes back, but for few false positives; what was never put in is mostly at level 0. So it is for a
    filter of ten million entries, beyond what one of fixed size would hold."""
    from corvid.llm import bloom

    for kind, n in ((1, 4000), (2, 4000), (2, 1_500_000)):
        keys = scoring.mix(np.arange(n, dtype=np.uint64), 20 + kind)
        counts = 1 + np.arange(n) % 50
        levels = scoring.level(counts, kind)
        f = bloom.of(keys, levels)
        got = f.levels(keys)
        assert (got >= levels).all() and (got == levels).mean() > 0.98
        other = f.levels(scoring.mix(np.arange(1 << 40, (1 << 40) + 20_000, dtype=np.uint64), 20 + kind))
        assert (other == 0).mean() > 0.98


def test_keys_are_packed_losslessly():
    rng = np.random.default_rng(0)
    for keys in (np.zeros(0, np.uint64), np.array([7], np.uint64), np.array([0, (1 << 64) - 1], np.uint64), np.arange(300, dtype=np.uint64), np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))):
        assert (common.unpacked(common.packed(keys)) == keys).all()
    assert len(common.packed(np.arange(1000, dtype=np.uint64))) < 1010


def test_levels_stand_for_counts_in_them():
    counts = np.arange(0, 2000)
    for kind in (1, 2):
        q = scoring.level(counts, kind)
        assert q[0] == 0 and (np.diff(q) >= 0).all() and q[1:].min() == 1 and set(q) == set(range(q.max() + 1))
        ratio = scoring.usual(kind)[q[1:]] / counts[1:]
        assert ratio.min() > 0.6 and ratio.max() < 1.6


def toy(spark):
    """Few words, whose counts and bigram counts the levels give exactly."""
    texts = ["a b a c", "b c a b", "c c d e"]
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 1][:3]
    return texts, spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")


def test_probabilities_sum_to_one(spark):
    """The next token's, over the whole vocabulary and one unknown word, after histories seen and never seen."""
    held = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 5 == 1]
    texts, train = toy(spark)
    vocabulary = ["a", "b", "c", "d", "e", "neverseen"]
    histories = ["", "a", "b", "c", "d", "neverheard"]
    # A history alone, and with each word after it: the difference is the word's probability, or the end's.
    rows, where = [], {}
    for h in histories:
        for w in vocabulary:
            where[h, w] = held[len(rows)]
            rows.append((held[len(rows)], f"{h} {w}"))
        where[h, None] = held[len(rows)]
        rows.append((held[len(rows)], h))
    for w in vocabulary:
        where["end", w] = held[len(rows)]
        rows.append((held[len(rows)], w))
    got = {r["doc_id"]: r["score"] for r in scoring.scored(train.union(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    start = {w: got[where["end", w]] for w in vocabulary}  # log P(w | start) + log P(end | w)
    total, V = 15, 6
    counts = Counter(x for t in texts for x in [*t.split(), None])
    pairs = Counter(p for t in texts for p in zip(["start", *t.split()], [*t.split(), None], strict=False))
    seen = Counter(a for a, _ in pairs.elements())

    def p(h, w):
        unigram = (counts[w] + 0.5) / (total + 0.5 * (V + 1))
        return unigram if not seen[h] else 0.5 * pairs[h, w] / seen[h] + 0.5 * unigram

    for h in ("start", "a", "b", "c", "d", "neverheard"):
        assert sum(p(h, w) for w in ["a", "b", "c", "d", "e", None, "neverseen"]) == pytest.approx(1)
    for w in vocabulary:
        assert start[w] == pytest.approx(math.log10(p("start", w) * p(w, None)))
        for h in histories[1:]:
            assert got[where[h, w]] == pytest.approx(math.log10(p("start", h) * p(h, w) * p(w, None)))


def test_levels_keep_the_mass_of_the_corpus(spark, docs, rows):
    """Over all training words, what their levels stand for sums to the corpus's tokens."""
    words = Counter(w for d, t in texts_of(rows).items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in t.encode().lower().split())
    counts = np.array(list(words.values()))
    q = scoring.level(counts, 1)
    means = np.bincount(q, counts) / np.maximum(np.bincount(q), 1)
    assert means[q].sum() == pytest.approx(counts.sum())


def test_scores_of_long_and_null_rows(spark):
    """A text beyond a slice, rows without doc_id, repeated rows, clashing names."""
    long = "word another " * 500_000
    rows = [(1, long), (None, "word x"), (None, "word x"), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("unit", F.lit(1)).withColumn("learn", F.lit("x"))
    got = sorted(((str(r["doc_id"]), r["n_tokens"], r["n_known"]) for r in scoring.scored(df).collect()))
    assert got == [("1", 1_000_001, 1_000_001), ("3", 1, 1), ("4", 1, 1), ("None", 3, 3), ("None", 3, 3)]


def test_media(docs, rows, none):
    got = {r["doc_id"]: r for r in media.digests(media.stored(docs)).collect()}
    for d, t in texts_of(rows).items():
        body = t.encode()
        full = body + bytes(-len(body) % 64 or (0 if body else 64))
        r = got[d]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(body), len(full))
        assert (r["payload_sha256"], r["tail_crc32"]) == (hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert got[1000]["feature"] == got[1001]["feature"]
    assert media.digests(media.stored(none)).count() == 0


@pytest.mark.parametrize("n", [1, 16, 17, 64, 65, 500])
def test_containers(n):
    payload = bytes((i * 31 + i // 7) % 256 for i in range(64 * n))
    data = media.mux(payload)
    (t,) = media.tracks(data)
    assert media.read_samples(data, t) == payload
    assert (t["codec"], t["n_samples"], t["ticks"]) == ("raw ", n, 64 * n)
    assert len(t["keyframes"]) == -(-n // 16)
    assert [data[o : o + s] for o, s in t["keyframes"]] == [payload[i * 64 : i * 64 + 64] for i in range(0, n, 16)]


def test_large_boxes_and_sizes():
    """64-bit box sizes, a last box that runs to the end, and sample sizes one by one."""
    data = media.mux(bytes(range(64)) * 3)
    at = data.index(b"mdat") - 4
    to_end = data[:at] + struct.pack(">I", 0) + data[at + 4 :]
    (t,) = media.tracks(to_end)
    assert media.read_samples(to_end, t) == bytes(range(64)) * 3
    wide = media.box(b"ftyp", b"isom") + struct.pack(">I4sQ", 1, b"free", 20) + b"1234"
    assert [p[-1] for p, _, _ in media.walk(wide)] == [b"ftyp", b"free"]


def test_probe(spark):
    good = media.mux(bytes(640))
    df = spark.createDataFrame([(1, good), (2, good[:200]), (3, b""), (4, None), (5, b"\x00\x00\x00\x04abcd")], "id int, media binary")
    got = {r["id"]: r["p"] for r in df.select("id", media.probe("media").alias("p")).collect()}
    assert got[1]["codec"] == "raw " and got[1]["error"] is None and got[1]["keyframes"][0]["length"] == 64
    assert got[2]["error"] and got[3]["error"] and got[5]["error"] and got[4]["codec"] is None


def test_probe_of_deep_files_and_several_tracks(spark):
    deep = b"tail"
    for _ in range(1500):
        deep = media.box(b"moov", deep)
    one, two = media.mux(bytes(640)), media.mux(bytes(64 * 40))
    both = bytearray(one)
    at = {k: next((s, e) for p, s, e in media.walk(f) if p == (b"moov", b"trak")) for k, f in ((1, one), (2, two))}
    (moov,) = [(s, e) for p, s, e in media.walk(one) if p == (b"moov",)]
    second = two[at[2][0] - 8 : at[2][1]]
    # The second track's tables point into a file as long as the second one.
    both[moov[1] : moov[1]] = second
    both[moov[0] - 8 : moov[0] - 4] = struct.pack(">I", moov[1] - moov[0] + 8 + len(second))
    both += bytes(len(two))
    rows = [(1, bytes(deep)), (2, bytes(both)), (3, media.box(b"ftyp", b"isom") + media.box(b"moof", media.box(b"traf", b"")))]
    got = {r["id"]: r["p"] for r in spark.createDataFrame(rows, "id int, media binary").select("id", media.probe("media").alias("p")).collect()}
    assert "deep" in got[1]["error"] and "fragments" in got[3]["error"]
    assert got[2]["error"] is None and [t["n_samples"] for t in got[2]["tracks"]] == [10, 40] and got[2]["n_samples"] == 10


def test_media_of_a_long_text(spark):
    """A text beyond a slice, one row among small ones, and rows that repeat a doc_id."""
    text = "wörd " * 900_000
    got = media.digests(media.stored(spark.createDataFrame([(1, text), (1, "a"), (None, "b")], "doc_id long, text string"))).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"]) for r in got) == [("1", 1), ("1", len(text.encode())), ("None", 1)]
    (long,) = [r for r in got if r["n_bytes"] > 9]
    full = text.encode() + bytes(-len(text.encode()) % 64)
    assert long["payload_sha256"] == hashlib.sha256(full).hexdigest() and long["n_keyframes"] == -(-len(full) // 64 // 16)


def test_scores_without_a_cap(spark):
    """A filter that needs more than a fixed size keeps its bits for an entry: unseen words and bigrams stay unseen."""
    ids = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 != 1][:300]
    new = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 1][:5]
    rows = [(d, " ".join(f"w{d}x{i}" for i in range(8000))) for d in ids] + [(d, " ".join(f"n{d}x{i}" for i in range(2000))) for d in new]
    got = {r["doc_id"]: r for r in scoring.scored(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    total = 300 * 8001
    space = total + 0.5 * (300 * 8000 + 2)
    # The first word follows the start, which was seen; the others follow words that were not.
    exact = math.log10(0.5 * 0.5 / space) + 1999 * math.log10(0.5 / space) + math.log10(300.5 / space)
    assert all(abs(got[d]["score"] - exact) / 2001 < 0.03 for d in new)


def test_scores_know_bigrams_of_count_one(docs, rows):
    """Against brute force with quantised counts of all words and bigrams, those that occur once among them."""
    texts = {d: [*t.encode().lower().split(), None] for d, t in texts_of(rows).items()}
    train = [w for d, w in texts.items() if zlib.crc32(str(d).encode()) % 5 != 1]
    singles, pairs = Counter(x for w in train for x in w), Counter(p for w in train for p in zip(["start", *w], w, strict=False))
    assert 1 in pairs.values()
    space = sum(singles.values()) + 0.5 * (len(singles) + 1)

    def values(counts, kind):
        n = np.array(list(counts.values()))
        q = scoring.level(n, kind)
        mean = np.bincount(q, n) / np.maximum(np.bincount(q), 1)
        return {k: mean[x] for k, x in zip(counts, q, strict=True)}

    words = {k: v for k, v in singles.items()}
    single, pair = values(words, 1), values(pairs, 2)

    def log10(before, word):
        n = {w: len(train) if w in (None, "start") else single.get(w, 0.0) for w in (before, word)}
        weight = 0.5 if n[before] else 0.0
        c = pair.get((before, word), 0.0)
        return math.log10(weight * c / max(n[before], c, 1) + (1 - weight) * (n[word] + 0.5) / space)

    for r in scoring.scored(docs).collect():
        w = texts[r["doc_id"]]
        assert r["score"] == pytest.approx(sum(log10(a, b) for a, b in zip(["start", *w], w, strict=False)), rel=1e-4)


def test_extraction_on_independent_layouts():
    """Pages that no template made: block F1 of what is kept, and of no page is the article lost."""
    from .layouts import LAYOUTS, page_and_blocks

    field = html_extract.default_field()
    hits = kept = wanted = 0
    for name, layout in LAYOUTS.items():
        page, blocks = page_and_blocks(layout)
        found = html_extract.blocks(page)
        got = Counter(b.text for b, y in zip(found, field.decode(found), strict=True) if y)
        common = sum((got & Counter(blocks)).values())
        assert common > len(blocks) / 2, name
        hits, kept, wanted = hits + common, kept + got.total(), wanted + len(blocks)
    assert len(LAYOUTS) >= 30 and 2 * hits / (kept + wanted) > 0.97


@pytest.mark.parametrize(
    "before",
    ["""<script>document.write("<p class='")</script>""", "<script><!-- var a=1; </script>", "<head><title>T</title>", "<template><p>x", "<div><template><p>gone</template></div>", "<svg><title>icon</title></svg>", "<style>a::before{content:'</p>'}</STYLE >", "<!-->"],
)
def test_no_page_is_lost(before):
    page = "<html>" + before + "<article><h1>Title here</h1><p>First paragraph of the story, with words.</p></article>"
    found = html_extract.blocks(page)
    kept = [b.text for b, y in zip(found, html_extract.default_field().decode(found), strict=True) if y]
    assert kept[-2:] == ["Title here", "First paragraph of the story, with words."]


def test_what_is_not_dropped():
    texts = [b.text for b in html_extract.blocks("<article><p>Let <math><mi>x</mi></math> be <object>an object</object> <noscript>shown</noscript>.</p><xmp><b>1 &amp; 2</b></xmp></article>")]
    assert texts == ["Let x be an object shown.", "<b>1 &amp; 2</b>"]


def test_extraction_of_a_long_page(spark):
    """One page beyond a slice of text, and repeated and null page_ids."""
    long = "<article><h1>Long one</h1>" + "<p>A sentence of the article that goes on for a while.</p>" * 60_000 + "</article>"
    df = spark.createDataFrame([(1, "u", long), (1, "u", "<article><p>Short text is here.</p></article>"), (None, None, None)], "page_id long, url string, html string")
    got = sorted(html_extract.extract(df).collect(), key=lambda r: r["n_chars"])
    assert [r["page_id"] for r in got] == [None, 1, 1]
    assert got[0]["text"] == "" and got[1]["text"] == "Short text is here." and got[2]["text"].count("\n\n") == 60_000
