"""Embedding as an operator: a model behind an interface, run batch by batch with retries, and vectors as stored bytes."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tries of one batch, and seconds to wait after the first failure and at most.
TRIES, FIRST_WAIT, LONGEST_WAIT = 6, 2.0, 60.0


def embedded(rows: DataFrame, make: Callable[[], object], id_col: str, text_col: str, prefix: str = "", batch: int = 32, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(id, embedding, error). ``make`` builds the model in each worker. A batch that fails TRIES times gives its error for its rows."""

    def run(batches):
        model = make()
        for b in batches:
            ids, texts = b.column(id_col), [prefix + (t or "") for t in b.column(text_col).to_pylist()]
            vectors: list = []
            errors: list = []
            for i in range(0, len(texts), batch):
                part = texts[i : i + batch]
                for attempt in range(TRIES):
                    try:
                        vectors += model.embed(part)
                        errors += [None] * len(part)
                        break
                    except Exception as e:
                        if attempt + 1 == TRIES:
                            vectors += [None] * len(part)
                            errors += [f"{type(e).__name__}: {e}"] * len(part)
                        else:
                            wait(min(LONGEST_WAIT, FIRST_WAIT * 2**attempt))
            yield pa.record_batch([ids, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())], names=[id_col, "embedding", "error"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, embedding array<float>, error string")


def from_bytes(column: Column | str) -> Column:
    """Little-endian float32 bytes as an array."""

    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<float>")(column)


def to_bytes(column: Column | str) -> Column:
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    run.__annotations__ = {"values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")(column)
