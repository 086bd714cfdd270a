"""Text and vector functions on small literals."""

import random

import pytest
from pyspark.sql import functions as F

from corvid.functions import vectors
from corvid.functions import text as T
from corvid.operators import chunking


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column).first()[0]


def test_fold(spark):
    assert one(spark, T.fold("x"), x="Straße ÉÑÇ ō") == "strasse enc o"
    assert one(spark, T.tokens("x"), x="Año_2020, ¡sí!") == ["ano", "2020", "si"]


def test_token_count(spark):
    assert one(spark, T.token_count("x"), x="") == 1
    assert one(spark, T.token_count("x"), x="a" * 10) == 3


def test_snippet(spark):
    text = "x" * 300 + "needle" + "y" * 300
    out = one(spark, T.snippet(F.col("x"), F.lit(301), 200), x=text)
    assert "needle" in out and out[0] == out[-1] == "…" and len(out) == 202


def test_fragment(spark):
    for title, want in ((None, True), ("II. DEL PROGRAMA", True), ("B. DOCUMENTACIÓN", True), ("corto", True), ("Ley General de Aguas Nacionales", False)):
        assert one(spark, T.is_fragment_title(F.lit(title).cast("string"))) is want


def test_int8_rounds_half_to_even(spark):
    q = one(spark, vectors.int8(F.array(F.lit(127.0), F.lit(2.5), F.lit(-2.5)))["q"])
    assert q[0] == 127 and q[1] == 2 and q[2] == -2


def test_sign_codes(spark):
    code = one(spark, vectors.sign_codes(F.array(F.lit(0.0), F.lit(-1.0), F.lit(3.0)), 3))
    assert code == [0b101]


def documents():
    para = "palabra " * 60
    table = "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 900
    return {
        "small": "# Título\n" + para,
        "h2": "\n".join(f"## Sección {i}\n\n" + (para + "\n\n") * (1 + 6 * (i % 2)) + ("### Parte\n\n" + (para + "\n\n") * 7) * (i % 3) for i in range(6)),
        "bold": "**ACUERDO NUMERO UNO**\n\n" + (para + "\n\n") * 20 + "**SEGUNDO TITULO**\n\n" + (para + "\n\n") * 9,
        "plain": (para + "\n\n") * 30,
        "long line": "a" * 9000,
        "table": "intro\n\n" + table + "\n# Otro\n" + table,
        "empty": "",
    }


@pytest.mark.parametrize("name", documents())
def test_chunks_fit(name):
    text = documents()[name]
    kind, rows = chunking.split(text)
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    for r in rows:
        assert chunking.default_count(r["text"]) <= 1.15 * chunking.SECTION_TOKENS  # line ends between rows aren't counted
    assert kind == {"small": "small", "h2": "h2_compound", "bold": "bold_headers", "plain": "plain", "long line": "plain", "table": "giant_table", "empty": "small"}[name]


@pytest.mark.parametrize("name", documents())
def test_recipes_give_chunks_back(name):
    text = documents()[name]
    for r in chunking.split(text)[1]:
        spans = chunking.spans(r["text"], text)
        assert "".join(s["lit"] if s["lit"] is not None else text[s["start"] : s["end"]] for s in spans) == r["text"]


def test_table_header_repeats():
    _, rows = chunking.split(documents()["table"])
    assert sum(r["text"].startswith("| a | b |") for r in rows) > 1
    assert rows[-1]["heading_path"] == ["Otro"]


def test_image_descriptions():
    text = "antes\n<!-- IMAGE_DESCRIPTION: a.png\nUna gráfica.\n-->\ndespués"
    assert chunking.inlined(text) == "antes\n[Imagen: a.png] Una gráfica.\n\ndespués"


def test_overlap_stays_within_its_budget():
    rng = random.Random(5)
    text = "\n\n".join("w" * rng.randint(3, 200) for _ in range(300))
    parts = chunking.by_tokens(text, 100, chunking.default_count, 20)
    assert all(chunking.default_count(p) <= 110 for p in parts)
    assert {w for p in parts for w in p.split("\n\n")} == set(text.split("\n\n"))
