import random

import pytest

LONG = "palabra larga " * 3000


def made(n=160, seed=3):
    """Documents with copies, near copies, shared passages, nulls, empty and very long texts."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(600)]

    def words(k):
        return [r.choice(vocabulary) for _ in range(k)]

    passage = words(60)
    rows = []
    for i in range(n):
        kind = i % 10
        w = words(r.randint(1, 260))
        if kind == 1 and rows:
            text = rows[r.randrange(len(rows))][1]
        elif kind == 2 and rows and rows[-2][1]:
            w = rows[-2][1].split(" ")
            w[r.randrange(len(w))] = "CHANGED"
            text = " ".join(w)
        elif kind == 3:
            text = " ".join(words(20) + passage + words(20))
        elif kind == 4:
            text = " ".join([w[0]] * 90 + words(10))
        elif kind == 5:
            text = " ".join(words(r.randint(0, 8)))
        elif kind == 6:
            text = "\n".join([" ".join(words(9)) + ".", "Ünïcode — ñandú", " \t\x0b" + " ".join(words(5)) + "  \r\n"])
        else:
            text = " ".join(w)
        rows.append((i, text, "s0" if i % 3 else f"s{i % 5}", "en" if i % 4 else None, len(text)))
    rows += [(1000, None, None, "en", 0), (1001, "", "s0", "en", 0), (1002, "  \n", "s0", "de", 3), (1003, LONG, "s1", "en", len(LONG)), (1004, LONG + "x", "s1", "en", len(LONG) + 1)]
    return rows


SCHEMA = "doc_id long, text string, source string, lang string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return made()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"n": F.lit(1), "key": F.lit("k"), "row": F.lit(2), "rep": F.lit(3), "ids": F.lit(None).cast("string"), "copies": F.lit(9), "recipe": F.lit("r")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(rows):
    return {d: t or "" for d, t, *_ in rows}
