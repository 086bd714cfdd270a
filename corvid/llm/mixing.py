"""Mixing sources to target weights by iterative proportional fitting.

The corpus is a table of cells (source, language, topic) with their tokens. Raking scales the cells again and again so that
their totals by source, by language and by topic meet the targets; what a cell's scaled tokens are of its own gives every
document in it the same probability, and a hash of the document's id decides.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.llm import topics as T
from corvid.llm.common import by_ids, hash_words, release, saved, slices, starts_of, trim_worker, utf8, workspace

TOPICS = 8
#: The table of cells is raked on the driver up to this many cells, by DataFrame steps beyond, which do the same sweeps.
DRIVER_CELLS = 200_000
#: Sweeps end when no probability moves by more than this.
SETTLED = 1e-11
MARGINS = ("source", "lang", "topic")


@dataclass(frozen=True)
class Targets:
    """Shares by margin; a value not named has its share of the corpus to the power ``temper`` (normalised).

    ``fraction``: expected tokens of the sample as a part of the corpus. ``most``: the largest probability (over 1: copies).
    ``sweeps``: most sweeps, where targets that no probabilities up to ``most`` meet keep the cells from settling.
    """

    shares: dict[str, dict[str, float]] = field(default_factory=dict)
    temper: dict[str, float] = field(default_factory=lambda: {"source": 0.7, "lang": 0.8, "topic": 0.9})
    fraction: float = 0.8
    most: float = 1.0
    sweeps: int = 400


def measured(docs: DataFrame, topics: int = TOPICS) -> DataFrame:
    """doc_id, source, lang, topic and tokens of every row, a written table.

    Tokens are words. The topic is one of ``topics`` found by k-means over all documents' words (see ``topics``); a document
    without words has topic '0' and counts one token. Null source and language are 'unknown'.
    """

    def run(batches):
        trim_worker()
        for batch in batches:
            for part in slices(batch, "text"):
                words, counts, n = [], [], []
                parts = [t.lower().split() for t in utf8(part.column("text"))]
                sizes = np.fromiter(map(len, parts), np.int64, len(parts))
                hashed = hash_words([w for p in parts for w in p])
                for a, k in zip(starts_of(sizes).tolist(), sizes.tolist(), strict=True):
                    found, times = np.unique(hashed[a : a + k], return_counts=True)
                    words.append(found)
                    counts.append(times)
                    n.append(max(1, k))
                raw = pa.array([v.tobytes() for v in T.vectors(words, counts).astype("<f4")], pa.binary())
                yield pa.record_batch([part.column("doc_id"), part.column("source"), part.column("lang"), pa.array(n, pa.int64()), raw], names=["doc_id", "source", "lang", "tokens", "vector"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string"), F.coalesce(F.col("source").cast("string"), F.lit("unknown")).alias("source"), F.coalesce(F.col("lang").cast("string"), F.lit("unknown")).alias("lang"))
    plain = saved(rows.mapInArrow(run, f"doc_id {kind}, source string, lang string, tokens bigint, vector binary"), "vectors")
    moved = T.centred(plain)
    out = saved(T.assigned(moved, T.fitted(moved, topics)).select("doc_id", "source", "lang", "topic", "tokens"), "measured")
    release(plain, moved)
    return out


def wanted(totals: dict[str, float], shares: dict[str, float], temper: float) -> dict[str, float]:
    """The share of each value: as named, the rest in proportion to its tokens to the power ``temper``."""
    named = {k: v for k, v in shares.items() if k in totals}
    rest = {k: v**temper for k, v in totals.items() if k not in named}
    left, whole = max(0.0, 1 - sum(named.values())), sum(rest.values())
    out = named | {k: left * v / whole for k, v in rest.items()}
    scale = sum(out.values()) or 1.0
    return {k: v / scale for k, v in out.items()}


def rake(cells: pd.DataFrame, targets: Targets) -> np.ndarray:
    """The probability of each cell (columns of MARGINS and tokens), in their order.

    One sweep scales every margin in turn, then lowers what is above ``most`` and spreads the difference over the others.
    """
    tokens = cells["tokens"].to_numpy(float)
    if not len(tokens):
        return np.zeros(0)
    budget = tokens.sum() * targets.fraction
    codes, goals = [], []
    for m in MARGINS:
        code, names = pd.factorize(cells[m], sort=True)
        totals = np.bincount(code, tokens)
        share = wanted(dict(zip(names, totals, strict=True)), targets.shares.get(m, {}), targets.temper.get(m, 1.0))
        codes.append(code)
        goals.append(np.array([share[k] for k in names]) * budget)
    p = np.full(len(tokens), targets.fraction)
    for _ in range(targets.sweeps):
        before = p
        for code, goal in zip(codes, goals, strict=True):
            now = np.bincount(code, p * tokens)
            p = p * np.where(now > 0, goal / np.where(now > 0, now, 1), 0)[code]
        p = np.minimum(p, targets.most)
        free = p < targets.most
        spare = budget - (p * tokens)[~free].sum()
        now = (p * tokens)[free].sum()
        if now > 0 and spare > 0:
            p = np.where(free, np.minimum(p * spare / now, targets.most), p)
        if np.abs(p - before).max() < SETTLED:
            break
    return p


def _raked_by_steps(cells: DataFrame, targets: Targets) -> DataFrame:
    """The same sweeps as DataFrame steps, for tables of cells of any size; every few sweeps the table is written."""
    budget = cells.agg(F.sum("tokens")).first()[0] * targets.fraction
    now = cells.withColumn("p", F.lit(targets.fraction))
    goals = {}
    for m in MARGINS:
        totals = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("t"))
        given = F.create_map(*[F.lit(x) for kv in targets.shares.get(m, {}).items() for x in kv]) if targets.shares.get(m) else F.create_map().cast("map<string,double>")
        totals = totals.withColumn("named", F.try_element_at(given, F.col(m))).withColumn("rest", F.when(F.col("named").isNull(), F.pow("t", F.lit(targets.temper.get(m, 1.0)))))
        a, b = totals.agg(F.coalesce(F.sum("named"), F.lit(0.0)), F.coalesce(F.sum("rest"), F.lit(0.0))).first()
        left = max(0.0, 1 - a)
        scale = a + (left if b else 0) or 1.0
        goals[m] = saved(totals.select(m, (F.coalesce("named", F.col("rest") * (left / (b or 1.0))) * (budget / scale)).alias("goal")), "goals")
    now = saved(now, "raked")
    for _ in range(targets.sweeps):
        last, now = now, now.withColumn("was", F.col("p"))
        for m in MARGINS:
            factor = now.groupBy(m).agg(F.sum(F.col("p") * F.col("tokens")).alias("now")).join(goals[m], m).select(m, F.when(F.col("now") > 0, F.col("goal") / F.col("now")).otherwise(0.0).alias("factor"))
            now = now.join(factor, m).withColumn("p", F.col("p") * F.col("factor")).drop("factor")
        now = now.withColumn("p", F.least("p", F.lit(targets.most)))
        swept = saved(now, "swept")
        free = F.col("p") < targets.most
        fixed, loose = swept.agg(F.coalesce(F.sum(F.when(~free, F.col("p") * F.col("tokens"))), F.lit(0.0)), F.coalesce(F.sum(F.when(free, F.col("p") * F.col("tokens"))), F.lit(0.0))).first()
        now = swept
        if loose > 0 and budget > fixed:
            now = swept.withColumn("p", F.when(free, F.least(F.col("p") * ((budget - fixed) / loose), F.lit(targets.most))).otherwise(F.col("p")))
        now = saved(now.withColumn("moved", F.abs(F.col("p") - F.col("was"))).drop("was"), "raked")
        release(last, swept)
        if (now.agg(F.max("moved")).first()[0] or 0) < SETTLED:
            break
        now = _dropped(now, "moved")
    release(*goals.values())
    return now


def _dropped(table: DataFrame, column: str) -> DataFrame:
    """A written table without a column, still known as written."""
    out = table.drop(column)
    out._written_to = table._written_to
    return out


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from a hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11) / F.lit(float(1 << 53))


def mixed(docs: DataFrame, targets: Targets | None = None, topics: int = TOPICS, driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """doc_id, source, lang, topic, tokens, probability and copies (0: not sampled) of every row.

    A null doc_id is hashed like any other; rows that repeat a doc_id share its draw. Texts of any length are measured whole. Other
    columns are ignored, whatever their names. An empty table gives no rows.
    """
    targets = targets or Targets()
    rows = measured(docs, topics)
    cells = saved(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    head = cells.limit(driver_cells + 1).toPandas()
    if len(head) <= driver_cells:
        head = head.sort_values(list(MARGINS), ignore_index=True)
        head["probability"] = rake(head, targets)
        # By Arrow, which the driver reads itself: rows of pandas would start a Python daemon and workers of their own on executors.
        raked = docs.sparkSession.createDataFrame(pa.table({c: pa.array(head[c], t) for c, t in (*((m, pa.string()) for m in MARGINS), ("probability", pa.float64()))}))
    else:
        raked = _raked_by_steps(cells, targets).select(*MARGINS, F.col("p").alias("probability"))
    release(cells)
    out = rows.join(raked, list(MARGINS), "left")
    return out.select("doc_id", *MARGINS, "tokens", F.round("probability", 9).alias("probability"), F.floor(F.col("probability") + uniform(F.col("doc_id"))).cast("int").alias("copies"))


def achieved(rows: DataFrame, targets: Targets | None = None) -> DataFrame:
    """(margin, value, target, expected, drawn): for each value its target share, its share by the probabilities and its share of
    the tokens drawn, from the rows of ``mixed``. Where the last two differ from the first, the targets could not be met."""
    targets = targets or Targets()
    out = None
    for m in MARGINS:
        totals = rows.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").cast("double").alias("t"), F.sum(F.col("tokens") * F.col("probability")).alias("e"), F.sum(F.col("tokens") * F.col("copies")).cast("double").alias("d"))
        given = targets.shares.get(m)
        named = F.try_element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]), F.col("value")) if given else F.lit(None).cast("double")
        totals = totals.withColumn("named", named).withColumn("rest", F.when(F.col("named").isNull(), F.pow("t", F.lit(targets.temper.get(m, 1.0)))))
        sums = totals.agg(F.sum("e").alias("es"), F.sum("d").alias("ds"), F.coalesce(F.sum("named"), F.lit(0.0)).alias("ns"), F.sum("rest").alias("rs"))
        part = totals.crossJoin(F.broadcast(sums))  # one row
        left = F.greatest(F.lit(0.0), 1 - F.col("ns"))
        scale = F.col("ns") + F.when(F.col("rs").isNotNull(), left).otherwise(0.0)
        part = part.select(F.lit(m).alias("margin"), "value", (F.coalesce("named", F.col("rest") * left / F.col("rs")) / scale).alias("target"), (F.col("e") / F.col("es")).alias("expected"), F.try_divide("d", "ds").alias("drawn"))
        out = part if out is None else out.unionByName(part)
    return out


def sampled(docs: DataFrame, targets: Targets | None = None) -> DataFrame:
    """The rows of ``docs`` that are sampled, once for each copy, with all their columns; rows that share a doc_id share its draw."""
    with workspace():
        drawn = mixed(docs, targets).filter("copies > 0").groupBy(F.col("doc_id").alias("_sampled_id")).agg(F.max("copies").alias("_sampled_copies"))
        chosen = saved(drawn, "sampled", keep=True)
    rows = by_ids(docs, chosen, docs["doc_id"].eqNullSafe(chosen["_sampled_id"]), "inner")
    return rows.withColumn("_sampled_copy", F.explode(F.sequence(F.lit(1), "_sampled_copies"))).select(*docs.columns)
